from pyspark.sql import functions as F

from hopmill.operators import accounting as X
from hopmill.operators import gates as G

REQUEST = "job_id string, kind string, status string, closed_world boolean, source_empty boolean, author string, request_sha256 string, source_sha256 string, draft_sha256 string, coverage array<string>, facets array<string>, core string"
RECEIPT = "job_id string, receipt_sha256 string, artifact_sha256 string, version string, scope string, request_sha256 string, source_sha256 string, draft_sha256 string, decision string, unresolved array<string>, reviewer_kind string, reviewer string, coverage array<string>, facets array<string>, core string"
REGISTRY = "receipt_sha256 string, artifact_sha256 string, reviewer string, verified boolean"
A = "ab" * 32
GOOD = {"artifact_sha256": A, "version": "v", "scope": "s", "request_sha256": "q", "source_sha256": "o", "draft_sha256": "d", "decision": "confirmed", "unresolved": [], "reviewer_kind": "human", "reviewer": "ann", "coverage": ["x", "y"], "facets": ["f"], "core": "c"}


def _routed(spark, requests, receipts, registry):
    names = [c.split()[0] for c in RECEIPT.split(", ")]
    rows = [tuple({**GOOD, **r}[n] for n in names) for r in receipts]
    got = G.gated_reviews(spark.createDataFrame(requests, REQUEST), spark.createDataFrame(rows, RECEIPT), spark.createDataFrame(registry, REGISTRY), "v", "s")
    return {r.job_id: tuple(r)[2:] for r in got.collect()}


def _request(job, kind="review", status="completed", closed=False, empty=False, author="bob"):
    return (job, kind, status, closed, empty, author, "q", "o", "d", ["x", "y"], ["f"], "c")


def test_each_check_of_a_receipt(spark):
    broken = {
        "artifact": {"artifact_sha256": A.upper()}, "authority": {"reviewer": "eve"}, "scope": {"scope": None}, "request": {"request_sha256": "z"}, "source": {"source_sha256": None},
        "draft": {"draft_sha256": "z"}, "decision": {"decision": "corrected"}, "unresolved": {"unresolved": None}, "coverage": {"coverage": ["y", "x"]}, "facets": {"facets": []}, "core": {"core": "z"},
    }
    jobs = [(n, dict(c)) for n, c in broken.items()] + [("independence", {"reviewer_kind": "model"}), ("registered", {})]
    receipts = [{"job_id": n, "receipt_sha256": f"r-{n}", **c} for n, c in jobs]
    registry = [(f"r-{n}", A, "ann", True) for n, _ in jobs if n != "registered"]
    got = _routed(spark, [_request(n) for n, _ in jobs], receipts, registry)
    assert got == {n: ("completed", G.OPEN, f"receipt_{n}", False) for n, _ in jobs}


def test_independence_and_the_best_receipt(spark):
    requests = [_request("own", author="ann"), _request("nobody", author=None), _request("blank"), _request("unverified"), _request("two"), _request("late", status="technical_failure")]
    receipts = [{"job_id": j, "receipt_sha256": j} for j in ("own", "nobody", "unverified", "two", "late")] + [{"job_id": "blank", "receipt_sha256": "blank", "reviewer": " "}, {"job_id": "two", "receipt_sha256": "lost"}, {"job_id": "stranger", "receipt_sha256": "own"}]
    registry = [(j, A, "ann", j != "unverified") for j in ("own", "nobody", "unverified", "two", "late")] + [("blank", A, " ", True), (None, A, "ann", True)]
    got = _routed(spark, requests, receipts, registry)
    no, yes = (G.OPEN, "receipt_independence", False), (G.CONFIRMED, None, True)
    assert got == {"own": ("completed", *no), "nobody": ("completed", *yes), "blank": ("completed", *no), "unverified": ("completed", *no), "two": ("completed", *yes), "late": ("technical_failure", *yes)}


def test_without_a_receipt(spark):
    requests = [_request("empty", "scoring", closed=True, empty=True), _request("open", "scoring", empty=True), _request("failed", "scoring", "protocol_failure", True, True), _request("null", None, None, None, None), _request("stock", "inventory", closed=True, empty=True)]
    got = _routed(spark, requests, [], [])
    assert got == {
        "empty": ("completed", G.DETERMINED, None, True), "open": ("completed", G.OPEN, G.SEMANTICS, False), "failed": ("protocol_failure", G.OPEN, G.NOT_COMPLETED, False),
        "null": (None, G.OPEN, G.NOT_COMPLETED, False), "stock": ("completed", G.OPEN, G.INVENTORY, False),
    }
    assert _routed(spark, [], [{"job_id": "a", "receipt_sha256": "a"}], []) == {}


def test_unfinished_trials(spark):
    rows = [("a", "adjudicated", True, None, "technical_failure"), ("a", "adjudicated", False, False, "technical_failure"), ("a", "adjudicated", None, None, None), ("a", "pending", True, None, "technical_failure"), ("a", None, True, True, "completed"), (None, None, False, None, "not_run")]
    df = spark.createDataFrame(rows, "arm string, ref_status string, expected_valid boolean, major_defect boolean, status string")
    got = {tuple(r) for r in G.unfinished_trials(df, ["arm"]).collect()}
    assert got == {("a", "technical_failure", 2, 1, 0), ("a", "not_run", 1, 0, 1), (None, "not_run", 1, 0, 1)}


def test_what_rounds_share(spark):
    cases = "kind string, case_id long, expected boolean, payload_sha256 string"
    jobs = "kind string, case_id long, arm string, status string, decision boolean, expected boolean"
    old = spark.createDataFrame([("k", 1, True, "p"), ("k", 2, True, "p"), ("k", 3, None, "p"), ("m", 1, False, None), ("k", 5, True, "p")], cases)
    new = spark.createDataFrame([("k", 1, True, "q"), ("k", 2, False, "p"), ("k", 3, True, "p"), ("m", 1, False, None), ("k", 4, True, "p")], cases)
    compared = X.round_comparison(old, new, ["kind", "case_id"])
    before = spark.createDataFrame([("k", 1, "x", "completed", True, True), ("k", 1, "x", "completed", False, True), ("k", 2, "x", "completed", True, True), ("m", 1, None, "not_run", None, False)], jobs)
    after = spark.createDataFrame([("k", 1, "x", "completed", True, True), ("k", 4, "x", "completed", True, True), ("m", 1, None, "completed", True, False)], jobs)
    got = {(r["round"], r["kind"], r["arm"]): (r["scheduled"], r["shared_cases"], r["correct_disposition"], r["false_block"], r["unsafe_accept"], r["not_run"]) for r in G.round_subsets(compared, before, after, ["kind", "case_id"], ["kind", "arm"]).collect()}
    assert got == {("previous", "k", "x"): (2, 1, 1, 1, 0, 0), ("previous", "m", None): (1, 1, 0, 0, 0, 1), ("current", "k", "x"): (1, 1, 1, 0, 0, 0), ("current", "m", None): (1, 1, 0, 0, 1, 0)}
    contracts = "kind string, schema_sha256 string, prompt_sha256 string"
    flags = G.contract_flags(compared, spark.createDataFrame([("k", "s", "p")], contracts), spark.createDataFrame([("k", "s", "z"), ("m", None, "p")], contracts))
    assert {tuple(r) for r in flags.collect()} == {("k", 1, False, True, False), ("m", 1, True, True, False)}


def test_only_digests_and_a_number_of_a_receipt_go_to_the_registry(spark, capsys):
    frames = [spark.createDataFrame([], s) for s in (REQUEST, RECEIPT, REGISTRY)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        G.gated_reviews(*(f.repartition(4) for f in frames), "v", "s").explain("formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    sent = [b.splitlines() for b in capsys.readouterr().out.split("\n\n") if ") Exchange\n" in b and "hashpartitioning(_receipt#" in b]
    assert len(sent) == 2 and all("_artifact#" in b[1] for b in sent)
    assert not any(c in b[1] for b in sent for c in ("request_sha256", "source_sha256", "draft_sha256", "coverage", "facets"))


def test_packed_digests_stay_apart(spark):
    hexes = ["0" * 64, "0" * 63 + "1", "A" * 64, "a" * 64, "a" * 64 + "\n", "a" * 63, "", "-", "-" * 32, "-" * 33, bytes.fromhex("61" * 32).decode()]
    got = spark.createDataFrame([(x,) for x in hexes], "x string").select(G._packed(F.col("x")).alias("p")).collect()
    assert len({bytes(r.p) for r in got}) == len(hexes) and len(got[3].p) == 32
