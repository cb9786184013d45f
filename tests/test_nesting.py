"""Nesting of source text, structural chunks and scopes."""

import random

import pytest

from weftline.functions import nesting
from weftline.operators import chunking, graph


def outline(text, language):
    """(prefix and name, depth) of each declaration, and the number of comments that are nodes."""
    t = nesting.tokens(text, language)
    found, comments = [], 0

    def visit(ns, depth):
        nonlocal comments
        for n in ns:
            comments += n.comment
            if n.name is not None:
                found.append((f"{n.prefix}{n.name}", depth))
            if not n.comment:
                visit(nesting.children(t, n), depth + (n.name is not None))

    visit(nesting.nodes(t), 0)
    return found, comments


SCRIPT = """// top { "
import { x } from './f'
export class Box<T> extends Base {
  /** doc } */
  open(a = {}) { const s = `}${ f({a:1}) + `}` }{`; helper(); }
  static async close(): Promise<void> {
    if (a) { b() } else { c() }
    const r = /[}/]{2}/.test(x)
  }
  value = 3
}
function helper() { return 1; } function* two() {}
export const f = async (x: number) => {
  const g = y => { return y }
}
abstract class Q {}
interface I { a: string }
foo
  .bar(function () { class Deep {} })
"""
GO = "package p\n\n// Doc {\nfunc (r *R) F(a int) string {\n\tif a > 1 {\n\t\treturn \"}\"\n\t} else {\n\t\tx := `}}`\n\t}\n}\n\ntype T struct {\n\tA int // trailing\n}\nfunc G() {}\n"
JAVA = 'package a;\n/** doc */\n@Anno(x = {1})\npublic class A<T> extends B {\n  private int x = 1;\n  public A(int y) { super(y); }\n  /* } */ @Two({1, 2}) public <R> String run(List<R> a) throws E { for (;;) { go("}"); } }\n  enum E { A, B; int z() { return 1; } }\n  record P(int a) { }\n}\ninterface J { }\n'
RUST = "use a::b;\n/// doc {\npub fn f<'a>(x: &'a str) -> String { let c = '}'; let s = r#\"}\"#; s }\nimpl<T> Tr for Foo<T> { fn go(&self) {} }\n#[derive(A)]\npub struct S { a: i32 }\nmod m { pub enum E { A } }\n"
CPP = "#include <a.h>\n#define X(a) \\\n  foo {\nstatic int add(int a, int b) { return a + b; /* } */ }\ntypedef struct P { int x; } P;\nnamespace n { class K : public B { public: K(int a) : b(a) {} void m() const { x(); } }; }\nauto s = R\"x(})\" } )x\";\nint v = 3;\n"
PYTHON = '"""doc\nclass X:\n"""\nimport os\n# about A\n@dec(\n  1)\nclass A(B):\n    """x"""\n    # inner\n    def m(self,\n          y):\n        if y:\n            return "}"\n        else:\n            def deep(): pass\n\n    async def n(self): pass\nx = [\n 1,\n]\ndef f():\n    pass\n# end\n'


@pytest.mark.parametrize(
    ("text", "language", "want", "comments"),
    [
        (SCRIPT, "typescript", [("class Box", 0), ("open", 1), ("close", 1), ("fn helper", 0), ("fn* two", 0), ("f", 0), ("g", 1), ("abstract class Q", 0), ("interface I", 0), ("class Deep", 0)], 2),
        (GO, "go", [("func F", 0), ("type T", 0), ("func G", 0)], 1),
        (JAVA, "java", [("class A", 0), ("A", 1), ("run", 1), ("enum E", 1), ("z", 2), ("record P", 1), ("interface J", 0)], 2),
        (RUST, "rust", [("fn f", 0), ("impl Foo", 0), ("fn go", 1), ("struct S", 0), ("mod m", 0), ("enum E", 1)], 1),
        (CPP, "cpp", [("add", 0), ("struct P", 0), ("namespace n", 0), ("class K", 1), ("K", 2), ("m", 2)], 1),
        (PYTHON, "python", [("class A", 0), ("def m", 1), ("def deep", 2), ("def n", 1), ("def f", 0)], 3),
        ("namespace A.B { public class C : D { int P { get; set; } public C() { } void M<T>() where T : X { } } }", "c_sharp", [("namespace A", 0), ("class C", 1), ("C", 2), ("M", 2)], 0),
        ("class A(val x: Int) {\n  fun <T> b(): T { return c }\n}\nfun String.ext() { }\nobject O { }\n", "kotlin", [("class A", 0), ("fun b", 1), ("fun ext", 0), ("object O", 0)], 0),
        ("struct A: B {\n  init(x: Int) { }\n  func go() -> Int { return 1 }\n}\nextension A { }\n", "swift", [("struct A", 0), ("init", 1), ("func go", 1), ("extension A", 0)], 0),
        ("<?php\nclass A extends B { public function m($x) { return '}'; } # no {\n}\nfunction f() { }\n", "php", [("class A", 0), ("m", 1), ("fn f", 0)], 1),
        ("mixin M on A { }\nclass B extends C { void m() { x('}'); } }\nint f() { return 1; }\n", "dart", [("mixin M", 0), ("class B", 0), ("m", 1), ("f", 0)], 0),
    ],
)
def test_outline(text, language, want, comments):
    assert outline(text, language) == (want, comments)


@pytest.mark.parametrize("language", sorted(nesting.DECLARATIONS))
def test_any_text_is_cut_without_gaps(language):
    rng = random.Random(language)
    parts = ["class A", "{", "}", "(", ")", "[", "]", ";", "\n", " ", "//", "/*", "*/", "'", '"', "`", "${", "def f():", "\n    ", "#", "x = 1", "=>", "function f()", "\\", "é🙂", '"""', "@", "else", "/"]
    for _ in range(60):
        text = "".join(rng.choices(parts, k=rng.randrange(120)))
        t = nesting.tokens(text, language)

        def visit(ns, low, high):
            for n in ns:
                assert low <= n.start < n.end <= high
                low = n.end
                if not n.comment:
                    visit(nesting.children(t, n), n.start, n.end)

        visit(nesting.nodes(t), 0, len(text))
        kept = "".join(text[n.start : n.end] for n in nesting.nodes(t))
        assert "".join(kept.split()) == "".join(text.split())
        found = chunking.CHUNKERS[language]("p", text, 20, 5)
        assert "".join(text[a:b] for a, b, _ in found) == text


def test_comments_go_to_what_follows_and_budgets_hold():
    unit = lambda k: f"/** about f{k} }} */\n// more\nfunction f{k}() {{\n" + "  call('{');\n" * 40 + "}\n"
    text = "".join(map(unit, range(4)))
    found = chunking.CHUNKERS["typescript"]("p.ts", text, 700, 100)
    assert [c for *_, c in found] == [f"p.ts > fn f{k}" for k in range(4)]
    assert all(text[a:b].lstrip().startswith(f"/** about f{k}") for k, (a, b, _) in enumerate(found))
    # unlike breadcrumbs join within 0.7 of the budget, tiny ones within 1.5 of that, and no chunk is raw beyond 4 times it
    small = lambda n, size: f"function f{n}() {{ {'x' * (size - 15)}; }}\n"
    sizes = lambda *s: [chunking._size(small(k, n)) for k, n in enumerate(s)]
    assert sizes(50, 60) == [50, 60]
    cut = lambda *s: len(chunking.CHUNKERS["javascript"]("p", "".join(small(k, n) for k, n in enumerate(s)), 100, 30))
    assert cut(40, 30, 90) == 2 and cut(45, 30, 90) == 3 and cut(29, 70, 90) == 2 and cut(29, 77, 90) == 3
    wide = "x = 1;\n" + " " * 500 + "y = 2;\n" + "z" * 99 + ";\n"
    assert [a for a, *_ in chunking.CHUNKERS["javascript"]("p", wide, 100, 30)] == [0, 6]
    assert [a for a, *_ in chunking.CHUNKERS["javascript"]("p", wide.replace(" " * 500, " " * 250), 100, 30)] == [0]


def test_chunks_of_files(spark):
    text = "".join(f"func F{k}() {{\n" + "\tcall(\"}\")\n" * 60 + "}\n\n" for k in range(3))
    rows = spark.createDataFrame([("a.go", "go", text), ("b.txt", "unknown", text), ("c.go", "go", None), ("d.go", "go", "")], "path string, language string, content string")
    got = chunking.semantic_chunks(rows).orderBy("path", "chunk_index").collect()
    assert [(r.path, r.breadcrumb) for r in got] == [("a.go", f"a.go > func F{k}") for k in range(3)] + [("d.go", "d.go")]
    assert [r.vec_start < r.raw_start for r in got] == [False, True, True, False]


GRAPH = """import { x as y, plain } from './g'
export class Box extends Base {
  open(a = helper()) { const s = `}${ helper() }`; this.close(); new Box(); other.close(); }
  close = async () => { y(); inner(); missing() }
}
function helper() { function inner() { return helper() } inner(); }
const f = (helper: number) => { helper(); plain() }
describe('all } of it', () => { it("x", () => { f() }) })
class One { m() { return this.m() } }
// helper()
const t = "helper()"
"""


def test_scopes(spark):
    files = spark.createDataFrame([("s/a.ts", GRAPH), ("s/g.ts", "export function x() {}\nfunction plain() { function x() {} }\n"), ("s/h.py", "x"), ("s/n.ts", None)], "path string, content string")
    nodes, edges = graph.script_graph(files)
    names = {(r.kind, r.name, r.start_line) for r in nodes.where("file_path = 's/a.ts'").collect()}
    assert names == {("file", "s/a.ts", 1), ("class", "Box", 2), ("method", "open", 3), ("method", "close", 4), ("function", "helper", 6), ("function", "inner", 6), ("function", "f", 7), ("test", "all } of it", 8), ("test", "x", 8), ("class", "One", 9), ("method", "m", 9)}
    short = lambda i: i.replace("symbol:s/", "").replace("test:s/", "").replace("file:s/", "")
    got = {(r.kind, short(r.from_id), short(r.to_id)) for r in edges.collect()}
    assert {(a, b) for k, a, b in got if k == "calls"} == {
        ("a.ts:open:3", "a.ts:helper:6"), ("a.ts:open:3", "a.ts:close:4"), ("a.ts:open:3", "a.ts:Box:2"), ("a.ts:close:4", "g.ts:x:1"), ("a.ts:inner:6", "a.ts:helper:6"),
        ("a.ts:helper:6", "a.ts:inner:6"), ("a.ts:f:7", "g.ts:plain:2"), ("a.ts:x", "a.ts:f:7"),
    }
    assert {(a, b) for k, a, b in got if k == "contains" and a.startswith("a.ts")} == {
        ("a.ts", "a.ts:Box:2"), ("a.ts:Box:2", "a.ts:open:3"), ("a.ts:Box:2", "a.ts:close:4"), ("a.ts", "a.ts:helper:6"), ("a.ts:helper:6", "a.ts:inner:6"), ("a.ts", "a.ts:f:7"),
        ("a.ts", "a.ts:all } of it"), ("a.ts:all } of it", "a.ts:x"), ("a.ts", "a.ts:One:9"), ("a.ts:One:9", "a.ts:m:9"),
    }
    assert {(a, b) for k, a, b in got if k == "imports"} == {("a.ts", "g.ts")}
