"""Contract findings: operations, regions, parameters, path items and the document."""

from loomgraph.operators import contracts


def contract(spark, operations=(), regions=(), parameters=(), items=(), documents=()):
    t = lambda rows, kind: spark.createDataFrame(list(rows), kind)
    return contracts.Contract(
        t(operations, "path string, method string, template string, at string, whole boolean"),
        t(regions, "at string, region string, sha256 string, complete boolean, region_at string"),
        t(parameters, "at string, place string, key string, required boolean, reserved boolean, sha256 string, rest_sha256 string, parameter_at string"),
        t(items, "template string, path string, at string, sha256 string, complete boolean"),
        t(documents, "at string, sha256 string, complete boolean"),
    )


def run(before, after):
    rows = contracts.findings(before, after).collect()
    return sorted((tuple(r[c] for c in contracts.FINDING) for r in rows), key=str)


def op(n, method="GET", whole=True):
    return (f"/{n}/{{}}", method, f"/{n}/{{id}}", f"/paths/{n}", whole)


def parameter(key, required=False, rest="r", reserved=False):
    return ("/paths/x", key.split(":")[0], key, required, reserved, f"{rest}{required}", rest, f"/p/{key}")


def test_parameters(spark):
    region = lambda sha: [("/paths/x", "parameters", sha, True, "/paths/x/parameters"), ("/paths/x", "responses", "same", True, None)]
    old = [parameter("path:0"), parameter("query:gone"), parameter("query:same"), parameter("query:turned"), parameter("query:both"), parameter("header:accept", reserved=True), parameter("query:rest"), parameter("query:eased", True)]
    new = [parameter("path:0", rest="s"), parameter("query:same"), parameter("query:turned", True), parameter("query:both", True, "s"), parameter("header:accept", True, reserved=True), parameter("query:rest", rest="s"), parameter("query:eased"), parameter("query:need", True), parameter("query:may"), parameter("path:1", True)]
    got = run(contract(spark, [op("x")], region("1"), old), contract(spark, [op("x")], region("2"), new))
    assert {(r[0], r[1], r[5], r[6]) for r in got} == {
        ("review_required", "path_parameter_changed", "path:0", None), ("review_required", "path_parameter_changed", "path:1", None), ("review_required", "parameter_removed", "query:gone", None),
        ("newly_required_parameter", None, "query:turned", "optional_to_required"), ("newly_required_parameter", None, "query:both", "optional_to_required"), ("review_required", "parameter_changed", "query:both", None),
        ("review_required", "parameter_changed", "header:accept", None), ("review_required", "parameter_changed", "query:rest", None), ("review_required", "parameter_changed", "query:eased", None),
        ("newly_required_parameter", None, "query:need", "added_required"), ("review_required", "parameter_added", "query:may", None),
    }
    at = {r[5]: r[8:] for r in got}
    assert at["query:gone"] == ("/p/query:gone", "/paths/x") and at["query:need"] == ("/paths/x", "/p/query:need")
    # parameters are not looked at where their region is as it was
    assert run(contract(spark, [op("x")], region("1"), old), contract(spark, [op("x")], region("1"), new)) == []


def test_operations_and_what_blocks_them(spark):
    item = lambda n, complete=True, path=True, sha="i": (f"/{n}/{{id}}", f"/{n}/{{}}" if path else None, f"/items/{n}", sha, complete)
    before = contract(spark, [op("a"), op("b"), op("c"), op("d"), op("d", "POST"), op("d"), op("e", whole=False)], [], [], [item("a"), item("n")])
    after = contract(spark, [op("d"), op("d", "POST"), op("e"), op("new")], [], [], [item("a"), item("b", False)])
    got = run(before, after)
    kinds = {(r[0], r[1], r[2], r[3], r[7], r[8], r[9]) for r in got}
    assert kinds == {
        ("operation_removed", None, None, "/a/{}", None, "/paths/a", "/items/a"), ("operation_removed", None, None, "/c/{}", None, "/paths/c", "/paths"),
        ("review_required", "incomplete_region", "path_item", "/b/{}", "operation_removed", "/paths/b", "/items/b"), ("operation_added", None, None, "/new/{}", None, "/paths", "/paths/new"),
        ("review_required", "ambiguous_identity", None, "/d/{}", None, "/paths/d", None), ("review_required", "incomplete_region", "operation", "/e/{}", None, "/paths/e", "/paths/e"),
        ("review_required", "incomplete_region", "path_item", None, None, None, "/items/b"), ("review_required", "region_changed", "path_item", None, None, "/items/n", None),
    }
    assert len(got) == 9  # the repeated operation stands twice
    # a path item whose path is not known blocks every operation that only the other side has
    got = run(contract(spark, [op("a")]), contract(spark, [], [], [], [item("z", False, False)]))
    assert [(r[1], r[7], r[9]) for r in got if r[3]] == [("incomplete_region", "operation_removed", "/items/z")]


def test_regions_and_the_document(spark):
    region = lambda name, sha, ok=True: ("/paths/x", name, sha, ok, f"/paths/x/{name}")
    before = contract(spark, [op("x")], [region("responses", "1"), region("security", "1"), region("servers", "1")], [], [], [("/info", "1", True), ("/servers", "1", True), ("/old", "1", True), ("/odd", "1", True), ("/same", "1", True)])
    after = contract(spark, [op("x")], [region("responses", "2"), region("security", "1", False), region("servers", "1")], [], [], [("/info", "2", True), ("/servers", "1", True), ("/new", "1", True), ("/odd", "1", False), ("/same", "1", True)])
    got = {(r[1], r[2], r[8], r[9]) for r in run(before, after)}
    assert got == {
        ("region_changed", "responses", "/paths/x/responses", "/paths/x/responses"), ("incomplete_region", "security", "/paths/x/security", "/paths/x/security"),
        ("document_region_changed", "document", "/info", "/info"), ("document_region_changed", "document", "/old", None), ("document_region_changed", "document", None, "/new"), ("incomplete_region", "document", "/odd", "/odd"),
    }
    none = contract(spark)
    assert run(none, none) == []
