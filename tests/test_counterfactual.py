"""Patches applied, read again and compared, on small file sets worked out by hand."""

import pytest

from loomgraph.plans.counterfactual import Rule, checked, run

FILES = {
    "app/__init__.py": "",
    "app/web.py": "from app import model\n\ndef page(x):\n    return model.load(x) + 1 - 2\n",
    "app/model.py": "from . import store\n\ndef load(x):\n    return store.get(x)\n\ndef twice(a, b):\n    return a * 2 + b * 2\n",
    "app/store.py": "import os\n\ndef get(x):\n    return x\n",
    "lib/tool.py": "from app.model import load\n",
    "README.md": "text\n",
}
RULES = [Rule("web-store", ["app/web.py"], ["app/store.py"]), Rule("store-web", ["app/store.py"], ["app/web.py", "lib/**"]), Rule("lib", ["lib/**"], ["app/web.py"])]


def table(spark, files):
    return spark.createDataFrame(list(files.items()), "path string, text string").repartition(2)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_rules_over_imports(spark):
    violations, states = checked(table(spark, FILES), RULES)
    assert rows(violations, "rule_id", "source", "target") == [("web-store", "app/web.py", "app/store.py")]
    assert {r.rule_id: (r.outcome, r.exhaustive, r.reasons) for r in states.collect()} == {"web-store": ("violated", True, {}), "store-web": ("satisfied_within_scope", True, {}), "lib": ("satisfied_within_scope", True, {})}
    shallow = {r.rule_id: (r.outcome, r.reasons) for r in checked(table(spark, FILES), RULES, depth=1)[1].collect()}
    assert shallow["web-store"] == ("incomplete_due_to_budget", {"depth_limit": True}) and shallow["store-web"] == ("satisfied_within_scope", {})
    open_ = {r.rule_id: (r.outcome, r.reasons) for r in checked(table(spark, FILES | {"app/store.py": "from app import gone\nfrom .missing import x\n"}), RULES)[1].collect()}
    assert open_["store-web"][0] == "unknown" and open_["store-web"][1] == {"import_boundary": True} or open_["store-web"][0] == "violated"


def test_a_patch_introduces_and_resolves(spark):
    patch = (
        "--- a/app/model.py\n+++ b/app/model.py\n@@ -1,4 +1,4 @@\n-from . import store\n+import json\n \n def load(x):\n-    return store.get(x)\n+    return json.loads(x)\n"
        "--- a/app/store.py\n+++ b/app/store.py\n@@ -1,4 +1,5 @@\n import os\n+from app import web\n \n def get(x):\n     return x\n"
        "--- /dev/null\n+++ b/app/new.py\n@@ -0,0 +1,2 @@\n+def fresh():\n+    return 1\n"
    )
    got = run(table(spark, FILES), patch, RULES)
    assert {p for p, _ in rows(got.files, "path", "text")} == {*FILES, "app/new.py"}
    assert rows(got.changes, "path", "entity_id", "category") == [("app/model.py", "app/model.py::load#0", "body"), ("app/new.py", "app/new.py::fresh#0", "added")]
    assert rows(got.delta, "rule_id", "source", "target", "delta") == [("store-web", "app/store.py", "app/web.py", "introduced"), ("web-store", "app/web.py", "app/store.py", "resolved")]
    assert rows(got.rules, "rule_id", "before", "after") == [("lib", "satisfied_within_scope", "satisfied_within_scope"), ("store-web", "satisfied_within_scope", "violated"), ("web-store", "violated", "satisfied_within_scope")]


def test_a_file_that_no_longer_parses(spark):
    patch = "--- a/app/model.py\n+++ b/app/model.py\n@@ -1,4 +1,4 @@\n-from . import store\n+from . import (\n \n def load(x):\n     return store.get(x)\n"
    got = run(table(spark, FILES), patch, RULES[:1])
    assert {c for *_, c in rows(got.changes, "path", "entity_id", "category")} == {"unknown"}
    # the search after the patch stops at the broken file, so nothing can be called resolved
    assert rows(got.rules, "rule_id", "after", "after_exhaustive") == [("web-store", "unknown", False)] and [r.delta for r in got.delta.collect()] == [None]


def test_patches_that_do_not_apply(spark):
    with pytest.raises(Exception, match="context_mismatch"):
        run(table(spark, FILES), "--- a/app/store.py\n+++ b/app/store.py\n@@ -1,1 +1,1 @@\n-nothing like it\n+x\n").files.collect()
    with pytest.raises(ValueError, match="unsafe_path"):
        run(table(spark, FILES), "--- a/../x\n+++ b/x\n")
    assert run(table(spark, FILES), "").changes.count() == 0
