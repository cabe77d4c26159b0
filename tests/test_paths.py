"""Path rules (module, symbol, boundary, depth) on the reference's cases."""

from pyspark.sql import functions as F

from fleetlens.functions import boundary_of, depth_after_src, impact_level, module_of, symbol_of


def _one(spark, expr, value):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("r")).first()["r"]


def test_module_and_symbol(spark):
    cases = [
        ("src/auth/login.ts", "Login", "auth"),
        ("src/utils/old-helper.ts", "OldHelper", "utils"),
        ("lib/helpers.ts", "Helpers", "lib"),
        ("index.ts", "Index", ""),
        ("src/components/user-profile.ts", "UserProfile", "components"),
        ("src/components/data_grid.ts", "DataGrid", "components"),
        ("src/index.ts", "Index", "index"),
        ("a/b/src/x.js", "X", "x"),
        ("src", "Src", ""),
    ]
    rows = spark.createDataFrame([(p,) for p, _, _ in cases], "path string").select(
        "path", symbol_of("path").alias("s"), module_of("path").alias("m")).collect()
    got = {r["path"]: (r["s"], r["m"]) for r in rows}
    for p, s, m in cases:
        assert got[p] == (s, m), p


def test_symbol_edge_cases(spark):
    assert _one(spark, symbol_of, "src/user-service_v2.ts") == "UserServiceV2"
    assert _one(spark, symbol_of, "src/foo.test.ts") == "Foo.test"
    assert _one(spark, symbol_of, ".eslintrc") == ".eslintrc"
    # extension longer than 4 characters after the dot is kept in the module
    assert _one(spark, module_of, "src/foo.backup/x.ts") == "foo.backup"
    assert _one(spark, module_of, "src/.hidden") == ".hidden"


def test_boundaries(spark):
    cases = {
        "src/auth/login.ts": "auth", "src/db/query.ts": "db", "src/config.ts": "root", "main.ts": "root",
        "src/auth": "auth", "components/helper.ts": "components", "src": "root", "lib/x/y": "x",
        "sources/a/b.ts": "a", "other/x.ts": "other",
    }
    for path, b in cases.items():
        assert _one(spark, boundary_of, path) == b, path


def test_depth(spark):
    for path, d in {"src/index.ts": 0, "src/utils/index.ts": 1, "src/a/b/index.ts": 2, "index.ts": 0,
                    "utils/index.ts": 1, "src/a/b/c/d/e/deep.ts": 5}.items():
        assert _one(spark, depth_after_src, path) == d, path


def test_impact_level(spark):
    rows = [("TestSymbol", []), ("lower", ["a", "b", "c", "d"]), ("lower", ["a"]), ("lower", ["a", "b", "c"]),
            ("lower", []), ("", []), ("9lives", []), ("ßeta", [])]
    df = spark.createDataFrame(rows, "name string, aff array<string>")
    got = [r[0] for r in df.select(impact_level("name", "aff")).collect()]
    assert got == ["high", "high", "medium", "medium", "low", "low", "high", "low"]
