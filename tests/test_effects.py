from __future__ import annotations

from graphmill.operators import resolve
from graphmill.plans.symbol_graph import EFFECT_RULES

TREE = "rev string, path string, blob_sha string, ingested_at long"
REFS = "blob_sha string, ordinal int, from_qualname string, ref_kind string, raw_name string, dotted string, line int"


def direct(spark, tree, refs, rules=EFFECT_RULES):
    return {tuple(r) for r in resolve.direct_effects(spark.createDataFrame(tree, TREE), spark.createDataFrame(refs, REFS), rules).select("rev", "id", "effect", "rank", "line").collect()}


def test_the_built_in_catalogue_is_known(spark):
    called = {
        "open!write": ("FS_WRITE", 2), "open!ambiguous": ("FS_READ", 1), "open": ("FS_READ", 2), "<attr>.execute": ("DB_WRITE", 0), "subprocess.run": ("PROCESS", 1), "uuid.uuid4": ("NONDETERMINISM", 2),
        "requests.get": ("NETWORK", 2), "requests.utils.quote": ("NETWORK", 1), "db.session.commit": ("DB_WRITE", 0), "cur.fetchone": ("DB_READ", 0), "os.getenv": ("ENV_READ", 2), "registry.put": ("DB_WRITE", 2),
    }
    refs = [("aa", i, f"f{i}", "call", name, None, 7) for i, name in enumerate([*called, "re.compile", "os.path.join"])]
    want = {("r", f"p.py::f{i}", *hit, 7) for i, hit in enumerate(called.values())}
    assert direct(spark, [("r", "p.py", "aa", 1)], refs, (*EFFECT_RULES, resolve.Rule("registry.put", "DB_WRITE", override=True))) == want
    assert len(resolve.CATALOGUE) == 34 and not any(r.override for r in resolve.CATALOGUE)


def test_first_party_names_take_overrides_only_and_per_revision(spark):
    tree = [("r1", "p.py", "aa", 1), ("r2", "p.py", "aa", 1), ("r2", "requests/__init__.py", "bb", 1), ("r1", "src/shutil.py", "bb", 1)]
    refs = [("aa", 0, "f", "call", "get", "requests.get", 3), ("aa", 1, "f", "call", "g", "requests.house.send", 4), ("aa", 2, "f", "call", "shutil.move", None, 5), ("aa", 3, "f", "global", "x", None, 6), ("aa", 4, "f", "call", "httpx.get", "", 9)]
    rules = (*resolve.CATALOGUE, resolve.Rule("requests.house.*", "DB_WRITE", override=True), resolve.Rule("*.get", "DB_READ", override=True))
    f = "p.py::f"
    assert direct(spark, tree, refs, rules) == {
        ("r1", f, "NETWORK", 2, 3), ("r1", f, "DB_WRITE", 1, 4), ("r1", f, "GLOBAL_MUTATE", 2, 6), ("r1", f, "NETWORK", 1, 9),
        ("r2", f, "DB_READ", 0, 3), ("r2", f, "DB_WRITE", 1, 4), ("r2", f, "FS_WRITE", 1, 5), ("r2", f, "GLOBAL_MUTATE", 2, 6), ("r2", f, "NETWORK", 1, 9),
    }
