from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions import text as fx
from weftline.operators import filters


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_paths(spark):
    paths = ["src/api.pb.go", "a/mock_x.go", "dist/main.js", "app/.next/page.ts", "x_pb2.py", "src\\vendor\\a.c", "Foo.Designer.cs", "lib/g.dart", "src/main.go", "generatedx.ts", "src/user.ts", "mydist.js"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", fx.is_generated(F.col("p")).alias("g"), fx.generated_penalty(F.col("p"), F.lit(100.0)).alias("s")).collect()
    assert [r.g for r in rows] == [True] * 7 + [False] * 5
    assert {r.s for r in rows} == {30.0, 100.0}
    got = one(spark, a=fx.language_of(F.lit("x/y.TSX")), b=fx.language_of(F.lit("x/y.unknownext")), c=fx.file_stem(F.lit("src/Auth-Service.test.ts")), d=fx.parent_prefix(F.lit("a > b > c")), e=fx.parent_prefix(F.lit("a")))
    assert tuple(got) == ("typescript", "unknown", "auth-service.test", "a > b", "")


def test_tokens(spark):
    got = one(spark, v=fx.query_variants(F.lit("apiKey")), w=fx.query_variants(F.lit("api_key")), x=fx.query_tokens(F.lit("AND (find) src/a.ts")), y=fx.query_tokens(F.lit(" : ")), z=fx.symbol_tokens(F.lit("class AuthService { login_user }")))
    assert got.v == ["apikey", "api_key"] and got.w == ["api_key", "apikey", "apiKey"] and got.y == []
    assert set(got.x) >= {"src/a.ts", "src/ats", "find", "ts"}
    assert set(got.z) >= {"AuthService", "authservice", "auth_service", "login_user", "loginUser"}


def test_overlap_is_by_ascii_words(spark):
    got = one(spark, s=fx.token_overlap(F.lit("Auth authService éauth x"), ["auth", "service", "none", "x"]))
    assert got.s == 1 + 0.5 + 0 + 1


def test_globs_and_filters(spark):
    rows = spark.createDataFrame([(p,) for p in ("src/a.ts", "src/x/b.ts", "src/x/b.test.ts", "docs/a.md")], "p string")
    keep = lambda i, e: [r.p for r in rows.where(fx.path_matches(F.col("p"), i, e)).collect()]
    assert keep(["src/*.ts"], []) == ["src/a.ts"] and keep(["src/**"], ["**.test.ts"]) == ["src/a.ts", "src/x/b.ts"] and keep([], ["docs/?.md"]) == ["src/a.ts", "src/x/b.ts", "src/x/b.test.ts"]
    p = spark.range(1).select(filters.parsed_query(F.lit("auth kind:class Language:go path:a/b  name:X y")).alias("p")).first().p
    assert (p.natural, p.kind, p.lang, p.path, p["name"]) == ("auth y", ["class"], ["go"], ["a/b"], ["X"])
    assert filters.parse_text("lang:ts")["natural"] == "lang:ts"


def test_field_filters_use_the_last_part(spark):
    rows = spark.createDataFrame([("a.ts", "a.ts > class Foo", "typescript"), ("b.py", "b.py > function bar", "python"), ("c.py", None, None)], "file_path string, breadcrumb string, language string")
    of = lambda q: [r.file_path for r in filters.field_filter(rows, filters.parse_text(q)).collect()]
    assert of("kind:class") == ["a.ts"] and of("lang:PYTHON") == ["b.py"] and of("name:bar kind:func") == ["b.py"] and of("path:.py") == ["b.py", "c.py"] and len(of("x")) == 3


def test_languages():
    assert filters.languages_for() is None and filters.languages_for(True, ["markdown"]) is None
    assert filters.languages_for(True, ["python", "markdown"]) == ["python"] and "unknown" in filters.languages_for(exclude=["go"])
    for bad in ({"include": ["go"], "exclude": ["go"]}, {"include": ["klingon"]}):
        try:
            filters.languages_for(**bad)
            raise AssertionError
        except ValueError:
            pass


def test_channels(spark):
    got = spark.range(1).select(filters.channels(F.lit(" req "), F.array(F.lit("AuthService"), F.lit(" login "), F.lit("login"))).alias("c"), filters.channels(F.lit("req"), F.lit(None).cast("array<string>")).alias("d")).first()
    assert tuple(got.c) == ("req", "AuthService login req", "req AuthService login") and tuple(got.d) == ("req", "req", "req")


def test_numbers(spark):
    got = one(spark, a=fx.estimated_tokens(F.lit("abcde")), b=fx.estimated_tokens(F.lit("{}()[];")), c=fx.estimated_tokens(F.lit(None).cast("string")), d=fx.savings_percent(F.lit(200), F.lit(51)), e=fx.savings_percent(F.lit(0), F.lit(1)), f=fx.format_cost(F.lit(0.009)), g=fx.format_cost(F.lit(1.235)), h=fx.format_bytes(F.lit(2048)), i=fx.truncate_middle(F.lit("abcdefghij"), 7))
    assert tuple(got) == (2, 2, 0, 75, 0, "$0.00", "$1.24", "2.00 KB", "ab...ij")


def test_relative_imports(spark):
    cases = [("a/b/c.ts", "./d", "a/b/d"), ("a/b/c.ts", "../d", "a/d"), ("c.ts", "../d", None), ("a/c.ts", "lib", None)]
    rows = spark.createDataFrame([c[:2] for c in cases], "f string, t string").select(fx.normalised_import(F.col("f"), F.col("t")).alias("p")).collect()
    assert [r.p for r in rows] == [c[2] for c in cases]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab_- \n\t{}x", max_size=12), min_size=1, max_size=5))
def test_sizes_hold_for_any_text(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fx.nws(F.col("t")).alias("n"), fx.line_of(F.col("t"), F.length("t")).alias("l")).collect()
    for r in rows:
        assert r.n == len([c for c in r.t if c not in " \t\r\n"]) and r.l == r.t.count("\n") + 1
