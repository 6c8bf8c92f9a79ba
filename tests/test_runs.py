import json
import socket
import sys
import threading
import types
import warnings
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tessera import operators as O
from tessera import plans
from tessera.errors import AuthError, ConfigError, HttpStatusError, MappingError, RateLimitError, RequestTimeout, ServerError
from tessera.sources import HttpTransport, Settings, dataset_records, for_each_result, from_records, read_dataset, results_to_pandas, save_results, write_json_lines
from tessera.streaming import run_stream, stream_results

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def echo(body):
    return json.dumps({"results": [{"name": e["name"], "curies": ["C:" + e["name"]]} for e in json.loads(body)["entities"]], "metadata": {}, "summary": {"n": 1}})


def short(body):
    got = json.loads(echo(body))
    got["results"].pop()
    return json.dumps(got)


def second_fails(body):
    if json.loads(body)["entities"][0]["name"] == "n1000":
        raise ServerError("Server error (HTTP 500): x", status_code=500)
    return echo(body)


def swapped(body):
    got = json.loads(echo(body))
    got["results"].reverse()
    return json.dumps(got)


def records(n):
    return ({"name": f"n{i}", **({"identifiers": {"HMDB": f"H{i}"}} if i == 0 else {"identifiers": {"hmdb": "x"}} if i == 1 else {})} for i in range(n))


def rows(df):
    return df.orderBy("ord").collect()


def test_chunks_of_1000(spark):
    asked = O.number_chunks(O.requests(from_records(spark, records(1001))))
    sizes = {r["chunk_id"]: (r["n"], len(json.loads(r["body"])["entities"])) for r in O.request_bodies(asked).collect()}
    assert sizes == {0: (1000, 1000), 1: (1, 1)}
    assert O.request_bodies(O.number_chunks(O.requests(from_records(spark, [])))).count() == 0


def test_request_body(spark):
    asked = O.number_chunks(O.requests(from_records(spark, records(1)), annotators=["a"], annotation_mode="all"))
    (body,) = [json.loads(r["body"]) for r in O.request_bodies(asked).collect()]
    assert body == {"entities": [{"name": "n0", "entity_type": "biolink:SmallMolecule", "identifiers": {"HMDB": "H0"}, "options": {"annotation_mode": "all", "annotators": ["a"]}}]}
    plain = O.number_chunks(O.requests(from_records(spark, records(1))))
    assert json.loads(O.request_bodies(plain).first()["body"])["entities"][0]["options"] == {"annotation_mode": "missing"}


def test_results_in_order_with_hints(spark):
    got = rows(plans.map_entities(records(1001), echo, spark=spark))
    assert [r["query_name"] for r in got] == [f"n{i}" for i in range(1001)] and all(r["resolved"] for r in got)
    assert got[0]["hmdb_hint"] == "H0" and got[1]["hmdb_hint"] is None and not any(r["order_mismatch"] for r in got)


def test_a_failing_chunk_fails_alone(spark):
    got = rows(plans.map_entities(records(2100), second_fails, spark=spark))
    assert [r["ord"] for r in got if r["error"]] == list(range(1000, 2000)) and len(got) == 2100
    assert {r["error"] for r in got if r["error"]} == {"Server error (HTTP 500): x"}


@pytest.mark.parametrize("transport", [short, lambda b: "{", lambda b: '{"results": null}', lambda b: '{"results": [null, null, null]}'])
def test_bad_envelopes_give_one_error_a_record(spark, transport):
    got = rows(plans.map_entities(records(3), transport, spark=spark))
    assert len(got) == 3 and all(r["error"] and not r["resolved"] for r in got)


def test_order_mismatch_is_flagged_and_kept(spark):
    got = rows(plans.map_entities(records(2), swapped, spark=spark, check_order=False))
    assert [(r["query_name"], r["primary_curie"], r["order_mismatch"]) for r in got] == [("n0", "C:n1", True), ("n1", "C:n0", True)]
    with pytest.warns(RuntimeWarning, match="2 entries name another entity .* 'n0'"):
        plans.map_entities(records(2), swapped, spark=spark)
    with warnings.catch_warnings():
        warnings.simplefilter("error", RuntimeWarning)
        plans.map_entities(from_records(spark, records(2)), swapped)
        plans.map_entities(records(2), echo, spark=spark)


def test_records(spark):
    got = rows(from_records(spark, [{"name": None}, {}, {"name": 5, "identifiers": None}]))
    assert [r["name"] for r in got] == [None, "", "5"]
    with pytest.raises(ValueError):
        from_records(spark, [{"name": "a", "identifiers": {"HMDB": 3}}])
    asked = O.requests(from_records(spark, [{"name": None}]))
    assert asked.first()["request"]["name"] == ""
    assert O.requests(from_records(spark, [{"name": None}]), compat=True).first()["request"]["name"] == "None"


def test_delay_warns(spark):
    with pytest.warns(DeprecationWarning):
        plans.map_entities([], echo, spark=spark, rate_limit_delay=0.01)
    with warnings.catch_warnings():
        warnings.simplefilter("error", DeprecationWarning)
        assert plans.map_entities([], echo, spark=spark).count() == 0


def test_features_run(spark):
    table = spark.createDataFrame([(5, "F1", "a_CE1"), (7, "F2", "b"), (9, "F3", "a")], "ord long, feature_id string, matched_name string")
    results, back = plans.map_features(table, echo)
    assert [(r["ord"], r["primary_curie"]) for r in rows(results)] == [(0, "C:a"), (1, "C:b")]
    assert {(r["feature_id"], r["query_name"]) for r in back.collect()} == {("F1", "a"), ("F2", "b"), ("F3", "a")}


def test_sinks(spark, tmp_path):
    results = plans.map_entities(records(3), echo, spark=spark)
    summary = O.summarize(results).first().asDict()
    save_results(results, summary, json_path=str(tmp_path / "deep/out.json"), tsv_path=str(tmp_path / "deep/out.tsv"))
    document = json.loads((tmp_path / "deep/out.json").read_text())
    assert document["summary"]["total_queried"] == 3 and [m["query_name"] for m in document["mappings"]] == ["n0", "n1", "n2"]
    assert "raw_response" not in document["mappings"][0] and "confidence_tier" not in document["mappings"][0] and document["mappings"][0]["error"] is None
    lines = (tmp_path / "deep/out.tsv").read_text().splitlines()
    assert lines[0].split("\t")[:3] == ["query_name", "hmdb_hint", "resolved"] and lines[1].split("\t")[:4] == ["n0", "H0", "True", "C:n0"] and len(lines) == 4
    save_results(results.where("false"), json_path=str(tmp_path / "none.json"))
    assert json.loads((tmp_path / "none.json").read_text()) == {"summary": None, "mappings": []}
    write_json_lines(results, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 3
    assert list(results_to_pandas(results)["query_name"]) == ["n0", "n1", "n2"]
    seen = []
    assert for_each_result(results, lambda r: seen.append(r["query_name"]), progress=True, total_hint=3) == 3 and seen == ["n0", "n1", "n2"]
    with pytest.raises(KeyError):
        for_each_result(results, lambda r: {}["x"])


def test_results_in_frames(spark):
    """Frames of bounded size hold all rows in order; together they are the one frame."""
    from tessera.sources import results_to_frames

    results = plans.map_entities(records(95), echo, spark=spark).repartition(3)
    frames = list(results_to_frames(results, rows=20))
    assert [len(f) for f in frames] == [20, 20, 20, 20, 15] and [i for f in frames for i in f.index] == list(range(95))
    whole = results_to_pandas(results)
    assert [n for f in frames for n in f["query_name"]] == list(whole["query_name"]) == [f"n{i}" for i in range(95)]
    want = O.flatten(results.orderBy("ord")).toPandas()
    assert whole.equals(want) and (whole.dtypes == want.dtypes).all()
    none = results_to_pandas(results.where("false"))
    assert list(none.columns) == list(want.columns) and not len(none)


def test_dataset_files(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("name\thmdb_id\nglucose\tHMDB1\nalanine\t\n")
    (tmp_path / "a.csv").write_text('name,hmdb_id\n"x, y",H\n')
    got = rows(dataset_records(read_dataset(spark, str(tmp_path / "a.tsv")), name_column="name", provided_id_columns=["hmdb_id"]))
    assert [(r["name"], r["identifiers"]) for r in got] == [("glucose", {"hmdb_id": "HMDB1"}), ("alanine", {})]
    assert read_dataset(spark, str(tmp_path / "a.csv")).first()["name"] == "x, y"
    with pytest.raises(ValueError):
        dataset_records(spark.range(1), name_column="id", provided_id_columns=["a,b"])


def test_partial_dataset_runs(spark):
    def lines(n):
        for i in range(n):
            yield json.dumps({"name": f"n{i}", "curies": ["C"]})
            yield ""
        raise MappingError("cut off")

    run = plans.map_dataset_file("x.tsv", lines(2), spark=spark)
    assert run.error == "cut off" and not run.complete and run.results.count() == 2
    assert tuple(run.status().first()) == ("cut off", False)
    with pytest.raises(MappingError, match="cut off"):
        run.raise_for_error()
    with pytest.raises(MappingError):
        plans.map_dataset_file("x.tsv", lines(0), spark=spark)
    seen = []
    plans.map_dataset_file("x.tsv", ['{"name": "a"}', "{"], spark=spark, on_result=lambda r: seen.append(r["query_name"])).raise_for_error()
    assert seen == ["a", "<unknown>"]


def test_dataset_files_of_many_splits(spark, tmp_path):
    """Files of several splits, and several files of different sizes: ordinals are gapless, in file order, and every row gets its own response."""
    for name, first, n in (("a", 0, 3500), ("b", 3500, 10), ("c", 3510, 2000)):
        (tmp_path / f"{name}.tsv").write_text("name\thmdb_id\n" + "".join(f"n{i}\tH{i}\n" for i in range(first, first + n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        frame = read_dataset(spark, str(tmp_path), sep="\t")
        assert frame.rdd.getNumPartitions() >= 5
        got = rows(plans.map_entities(dataset_records(frame, name_column="name", provided_id_columns=["hmdb_id"]), echo))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r["ord"], r["query_name"], r["primary_curie"]) for r in got] == [(i, f"n{i}", f"C:n{i}") for i in range(5510)]
    frame = spark.range(30, numPartitions=3).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), (F.col("id") * 7 % 30).alias("by"))
    got = rows(plans.map_entities(dataset_records(frame, name_column="name", provided_id_columns=[]), echo))
    assert [(r["query_name"], r["resolved"]) for r in got] == [(f"n{i}", True) for i in range(30)]
    by = rows(dataset_records(frame, name_column="name", provided_id_columns=["by"], ord_col="by"))
    assert [r["ord"] for r in by] == list(range(30)) and [r["identifiers"]["by"] for r in by] == [str(i) for i in range(30)]


def test_results_are_delivered_as_lines_come(spark):
    asked, seen = [], []

    def lines(n):
        try:
            for i in range(n):
                asked.append(i)
                yield json.dumps({"name": f"n{i}", "curies": ["C"]})
                yield ""
        finally:
            asked.append("closed")

    run = plans.map_dataset_file("x.tsv", lines(40), spark=spark, on_result=lambda r: seen.append((r["query_name"], len(asked))))
    assert run.complete and [n for n, _ in seen] == [f"n{i}" for i in range(40)] and run.results.count() == 40
    assert seen[0][1] == 1 and seen[2][1] <= 3, "the first result comes before the second line is asked for"
    asked.clear()

    def fails(row):
        if row["query_name"] == "n2":
            raise KeyError("mine")

    with pytest.raises(KeyError, match="mine"):
        plans.map_dataset_file("x.tsv", lines(10_000), spark=spark, on_result=fails)
    assert asked[-1] == "closed" and len(asked) < 10
    stop = plans.StopHandle(spark)
    asked.clear()
    run = plans.map_dataset_file("x.tsv", lines(10_000), spark=spark, on_result=lambda r: r["query_name"] == "n6" and stop.stop(), stop=stop)
    assert not run.complete and "stopped" in run.error and run.results.count() == 7 and asked[-1] == "closed"


def test_progress(spark, monkeypatch):
    lines, got = [json.dumps({"name": str(i)}) for i in range(3)], []
    plans.map_dataset_file("x.tsv", lines, spark=spark, progress=lambda done, total: got.append((done, total)), total_hint=10)
    assert got == [(1, 10), (2, 10), (3, 10)]
    got.clear()
    assert len(rows(plans.map_entities(records(9100), echo, spark=spark, progress=lambda done, total: got.append((done, total))))) == 9100
    assert got == [(4000, 9100), (8000, 9100), (9100, 9100)]
    bars = []

    class Bar:
        def __init__(self, **options):
            self.options, self.n, self.closed = options, 0, 0
            bars.append(self)

        def update(self, n):
            self.n += n

        def close(self):
            self.closed += 1

    monkeypatch.setitem(sys.modules, "tqdm", types.SimpleNamespace())
    monkeypatch.setitem(sys.modules, "tqdm.auto", types.SimpleNamespace(tqdm=Bar))
    plans.map_dataset_file("x.tsv", lines, spark=spark, progress=True)
    plans.map_dataset_file("x.tsv", lines, spark=spark, total_hint=99)
    assert [(b.options["total"], b.n, b.closed) for b in bars] == [(None, 3, 1)]
    with pytest.raises(KeyError):
        plans.map_dataset_file("x.tsv", lines, spark=spark, progress=True, total_hint=4, on_result=lambda r: {}["x"])
    assert bars[-1].options["total"] == 4 and bars[-1].closed == 1
    monkeypatch.setitem(sys.modules, "tqdm.auto", None)
    assert plans.map_dataset_file("x.tsv", lines, spark=spark, progress=True).results.count() == 3


def test_a_stopped_run_keeps_what_was_sent(spark):
    stop = plans.StopHandle(spark)
    got = rows(plans.map_entities(records(9100), echo, spark=spark, stop=stop, progress=lambda done, total: done >= 4000 and stop.stop()))
    assert len(got) == 9100 and [r["ord"] for r in got if r["resolved"]] == list(range(4000))
    assert {r["error"] for r in got[4000:]} == {"Not sent: the run was stopped"}
    assert all(r["error"] for r in rows(plans.map_entities(records(3), echo, spark=spark, stop=stop)))
    assert plans.map_entities([], echo, spark=spark, stop=plans.StopHandle(spark)).count() == 0


def test_a_long_run_stops_after_its_first_chunk(spark):
    """More chunks than steps: the first step is one chunk nevertheless."""
    from tessera.plans.mapping import CANCELLED, send_chunks

    def run(stop, progress):
        bodies = spark.range(250).selectExpr("id AS chunk_id", "1L AS n", "'{}' AS body")
        return send_chunks(bodies, lambda body: body, parallel=1, stop=stop, progress=progress)

    stop, seen = plans.StopHandle(spark), []
    got = run(stop, lambda done, total: (seen.append((done, total)), stop.stop())).collect()
    assert seen == [(1, 250)] and sorted((r["chunk_id"], r["response"], r["error"]) for r in got) == [(0, "{}", None)] + [(i, None, CANCELLED) for i in range(1, 250)]
    seen.clear()
    assert sorted(r["chunk_id"] for r in run(None, lambda done, total: seen.append(done)).collect() if r["response"]) == list(range(250))
    assert seen[:10] == list(range(1, 11)) and seen[-1] == 250 and len(seen) < 60


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.ndjson").write_text('{"name": "a", "curies": ["C"]}\n\n{"name": \n')
    batches = []
    for name, on_batch in (("p", None), ("q", lambda df, n: batches.append(df.count()))):
        run = run_stream(stream_results(spark, str(tmp_path / "in")), str(tmp_path / name), str(tmp_path / f"c{name}"), on_batch=on_batch)
        assert {(r["query_name"], r["resolved"]) for r in run.results.collect()} == {("a", True), ("<unknown>", False)} and run.complete
    assert batches == [2]


class Service(BaseHTTPRequestHandler):
    protocol_version = "HTTP/1.1"
    peers: list = []

    def log_message(self, *a):
        pass

    def answer(self, code, body, **headers):
        self.send_response(code)
        self.peers.append(self.client_address)
        self.send_header("Content-Length", str(len(body.encode())))
        for k, v in headers.items():
            self.send_header(k.replace("_", "-"), v)
        self.end_headers()
        self.wfile.write(body.encode())

    def do_GET(self):
        self.path = self.path.removeprefix("http://far.invalid/v1")  # as a proxy is asked
        code = {"/health": 200, "/annotators": 401, "/vocabularies": 429, "/entity-types": 200}[self.path]
        body = '{"status": "ok"}' if self.path == "/health" else json.dumps({"entity_types": ["A"], "aliases": {"a": "A"}})
        self.answer(code, body, Retry_After="1.5" if code == 429 else "")

    def do_POST(self):
        body = self.rfile.read(int(self.headers["Content-Length"])).decode("utf-8", "replace")
        assert self.headers["X-API-Key"] == "k"
        if self.path == "/map/batch":
            self.answer(200, echo(body))
        elif self.path == "/map/entity":
            name = json.loads(body)["name"]
            self.answer({"bad": 503, "no": 404}.get(name, 200), json.dumps({"result": {"name": name, "curies": ["C"]}, "metadata": {}}) if name not in ("bad", "no") else "y" * 500)
        else:
            assert "name_column=name" in self.path and "glucose" in body
            self.answer(200, '{"name": "glucose", "curies": ["C"]}\n')


@pytest.fixture(scope="module")
def service():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield HttpTransport(Settings(f"http://127.0.0.1:{server.server_port}/", "k", timeout=10))
    server.shutdown()


def test_http(spark, service, tmp_path):
    assert service.health() == {"status": "ok"} and service.health()
    assert len(set(Service.peers)) == 1, "one connection for both"
    service.close()
    with service:
        assert service.health() == {"status": "ok"}
    assert service._kept is None and cloudpickle.loads(cloudpickle.dumps(service)).settings == service.settings
    assert rows(plans.map_entities(records(2), service, spark=spark))[1]["primary_curie"] == "C:n1"
    got = plans.map_entity("a", service, spark=spark, identifiers={"HMDB": "H"})
    assert got["resolved"] and got["hmdb_hint"] == "H" and got["raw_response"]
    with pytest.raises(ServerError) as e:
        plans.map_entity("bad", service, spark=spark)
    assert e.value.status_code == 503 and str(e.value).count("y" * 200) == 1 and "y" * 201 not in str(e.value)
    with pytest.raises(HttpStatusError):
        plans.map_entity("no", service, spark=spark)
    assert plans.list_catalog("entity-types", service, spark=spark).first()["aliases"] == ["a"]
    with pytest.raises(AuthError):
        plans.list_catalog("annotators", service, spark=spark)
    with pytest.raises(RateLimitError) as e:
        plans.list_catalog("vocabularies", service, spark=spark)
    assert e.value.retry_after == 1.5
    (tmp_path / "m.tsv").write_text("name\nglucose\n")
    run = plans.map_dataset_file(str(tmp_path / "m.tsv"), service, spark=spark, name_column="name", provided_id_columns=[])
    assert run.results.first()["query_name"] == "glucose"
    with pytest.raises(ValueError):
        plans.map_dataset_file(str(tmp_path / "m.tsv"), service, spark=spark, name_column="name", provided_id_columns=["a,b"])


def test_transport_options(service):
    near = service.settings.base_url.removeprefix("http://")
    with HttpTransport(Settings("http://far.invalid/v1/", "k", proxy=near, connect_timeout=2, headers={"X-More": "1"})) as far:
        assert far.health() == {"status": "ok"}
    with pytest.raises(MappingError):
        HttpTransport(Settings("http://127.0.0.1:9", "k", timeout=2)).health()
    with pytest.raises(OSError):
        HttpTransport(Settings("https://127.0.0.1", "k", ca_file="/nowhere.pem"))._connect()


def test_a_silent_service_times_out():
    with socket.socket() as quiet:
        quiet.bind(("127.0.0.1", 0))
        quiet.listen()
        with pytest.raises(RequestTimeout):
            HttpTransport(Settings(f"http://127.0.0.1:{quiet.getsockname()[1]}", "k", timeout=0.2)).health()


def test_a_closed_connection_is_opened_again(service):
    assert service.health() == service.health()
    service._kept.sock.shutdown(socket.SHUT_RDWR)
    assert service.health() == {"status": "ok"}


def test_settings(monkeypatch):
    monkeypatch.delenv("TESSERA_API_KEY", raising=False)
    with pytest.raises(ConfigError):
        Settings("http://x")
    monkeypatch.setenv("TESSERA_API_KEY", "e")
    with pytest.raises(ConfigError):
        Settings("x")
    assert Settings("http://x/").base_url == "http://x" and Settings("http://x").api_key == "e"
