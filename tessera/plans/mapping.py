"""Mapping runs. The transport is any picklable callable from a chunk's JSON body to the response's JSON."""

from __future__ import annotations

import contextlib
import json
import time
import warnings
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tessera.errors import MappingError, RateLimitError
from tessera.operators import as_requests, build_queue, correlate, from_envelope, from_ndjson, join_back, number_chunks, request_bodies, requests
from tessera.operators import catalog as catalogs
from tessera.control import Progress, StopHandle, tagged, ticking
from tessera.plans.scratch import scratch_path, write_once
from tessera.schemas import DEFAULT_ANNOTATION_MODE, DEFAULT_ENTITY_TYPE
from tessera.sources.http import HttpTransport
from tessera.sources.records import content_type, from_records, reject_commas

Transport = Callable[[str], str]


#: Chunks that are in flight at once unless told otherwise; a run that shows progress or can be stopped sends in steps of so many chunks, or of this part of the chunks sent before.
PARALLEL, STEP = 4, 0.1
CANCELLED, STOPPED = "Not sent: the run was stopped", "The run was stopped"


def send_chunks(bodies: DataFrame, transport: Transport, *, parallel: int = PARALLEL, delay: float = 0.0, progress: Progress = False, stop: StopHandle | None = None) -> DataFrame:
    """chunk_id, response and error of each chunk, sent once and written once.

    Bodies are built in parallel and written first. A failing chunk is a row with
    its error and never a failed task, which Spark would try again and so send
    twice. Each of ``parallel`` tasks sends in order of the chunks and pauses as
    told after a 429; one task sends one chunk after the other. ``delay`` is a
    pause between the chunks of a task. A transport with ``close`` is opened and
    closed by each task. A run with progress or a handle sends in steps, the first
    of ``parallel`` chunks, later ones of a tenth of what was sent; chunks that a
    stopped run didn't send are errors of their own.
    """

    def send(batches):
        first = True
        try:
            for batch in batches:
                for chunk_id, body in zip(batch["chunk_id"], batch["body"]):
                    if delay > 0 and not first:
                        time.sleep(delay)
                    first, response, error = False, None, None
                    try:
                        response = transport(body)
                    except Exception as e:  # one bad chunk must not end the run
                        error = str(e) or type(e).__name__
                        if isinstance(e, RateLimitError) and e.retry_after:
                            time.sleep(max(e.retry_after, delay))
                    yield pd.DataFrame({"chunk_id": [chunk_id], "response": [response], "error": [error]})
        finally:
            if hasattr(transport, "close"):
                transport.close()

    spark, names = bodies.sparkSession, "chunk_id long, response string, error string"
    bodies = write_once(bodies.select("chunk_id", "n", "body"), "bodies")
    path = scratch_path(spark, "responses")

    def step(part: DataFrame) -> None:
        dealt = part.select("chunk_id", "body")
        dealt = dealt.coalesce(1) if parallel == 1 else dealt.repartitionByRange(parallel, "chunk_id")
        dealt.sortWithinPartitions("chunk_id").mapInPandas(send, names).write.mode("append").parquet(path)

    if progress is False and stop is None:
        step(bodies)
        return spark.read.schema(names).parquet(path)
    last, records = bodies.agg(F.max("chunk_id"), F.sum("n")).first()
    last, sent = -1 if last is None else last, 0
    with ticking(progress, records or 0, "Mapping entities") as tick, tagged(spark, stop):
        while sent <= last and not (stop and stop.stopped):
            width = max(parallel, int(sent * STEP))  # the first steps are single rounds, whatever the size of the run
            part = bodies.where(F.col("chunk_id").between(sent, sent + width - 1))
            try:
                step(part)
            except Exception:
                if not (stop and stop.stopped):
                    raise
                break
            tick(part.agg(F.sum("n")).first()[0] or 0)
            sent += width
    if last < 0:
        return spark.createDataFrame([], names)
    done = spark.read.schema(names).parquet(path) if sent else spark.createDataFrame([], names)
    rest = bodies.where(F.col("chunk_id") >= sent).select("chunk_id", F.lit(None).cast("string").alias("response"), F.lit(CANCELLED).alias("error"))
    return done.where(F.col("chunk_id") < sent).unionByName(rest)


def warn_of_mismatches(results: DataFrame) -> int:
    """How many entries name another entity than was sent; a RuntimeWarning if any does."""
    row = results.where("order_mismatch").agg(F.count("*").alias("n"), F.min_by("query_name", "ord").alias("first")).first()
    if row["n"]:
        warnings.warn(f"{row['n']} entries name another entity than was sent, the first for {row['first']!r}", RuntimeWarning, stacklevel=3)
    return row["n"]


def map_entities(
    records: DataFrame | Iterable[dict],
    transport: Transport,
    *,
    spark: SparkSession | None = None,
    entity_type: str = DEFAULT_ENTITY_TYPE,
    annotation_mode: str = DEFAULT_ANNOTATION_MODE,
    annotators: list[str] | None = None,
    rate_limit_delay: float = 0.0,
    parallel: int = PARALLEL,
    compat: bool = False,
    progress: Progress = False,
    stop: StopHandle | None = None,
    check_order: bool | None = None,
) -> DataFrame:
    """One result for each record, keyed by ``ord`` (gapless from 0); chunks of at most 1000 fail on their own.

    check_order: count entries that name another entity than was sent and warn of
    them at once; by default for records in memory. The column ``order_mismatch``
    marks them in any case.
    """
    if rate_limit_delay > 0:
        warnings.warn("rate_limit_delay is deprecated", DeprecationWarning, stacklevel=2)
    if check_order is None:
        check_order = not isinstance(records, DataFrame)
    if not isinstance(records, DataFrame):
        records = from_records(spark or SparkSession.active(), records)
    asked = number_chunks(requests(records, entity_type=entity_type, annotation_mode=annotation_mode, annotators=annotators, compat=compat))
    responses = send_chunks(request_bodies(asked), transport, parallel=parallel, delay=rate_limit_delay, progress=progress, stop=stop)
    results = correlate(asked, responses)
    if check_order:
        warn_of_mismatches(results)
    return results


def map_entity(name: str, transport: HttpTransport, *, spark: SparkSession | None = None, entity_type: str = DEFAULT_ENTITY_TYPE, identifiers: dict | None = None, annotation_mode: str = DEFAULT_ANNOTATION_MODE, annotators: list[str] | None = None) -> Row:
    """One entity by the single endpoint; errors of the service are raised."""
    options = {"annotation_mode": annotation_mode} | ({} if annotators is None else {"annotators": annotators})
    response = transport.single({"name": name, "entity_type": entity_type, "identifiers": identifiers or {}, "options": options})
    frame = (spark or SparkSession.active()).createDataFrame([(name, response, (identifiers or {}).get("HMDB"))], "name string, response string, hint string")
    return from_envelope(frame, hint=F.col("hint")).first()


def map_features(features: DataFrame, transport: Transport, *, queue_options: dict | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """Results of the distinct names of a feature table, and each feature joined back to its result."""
    from tessera.sources.records import with_ord

    queue = with_ord(build_queue(features, **(queue_options or {})).withColumnRenamed("ord", "first_ord"), "first_ord")
    results = map_entities(as_requests(queue), transport, **options)
    return results, join_back(results, queue)


@dataclass
class DatasetRun:
    """Results of a dataset run, and the error that cut it short, if one did."""

    results: DataFrame
    error: str | None = None

    @property
    def complete(self) -> bool:
        return self.error is None

    def raise_for_error(self) -> None:
        """Raises the error, if any; the results stay."""
        if self.error is not None:
            raise MappingError(self.error)

    def status(self) -> DataFrame:
        return self.results.sparkSession.createDataFrame([(self.error, self.complete)], "error string, complete boolean")


def dataset_query(*, name_column: str, provided_id_columns: list[str], entity_type: str = DEFAULT_ENTITY_TYPE, annotation_mode: str = DEFAULT_ANNOTATION_MODE, annotators: list[str] | None = None, vocab: str | None = None) -> dict[str, str]:
    """Parameters of the dataset endpoint; lists are joined by commas, so their values mustn't hold any."""
    reject_commas("provided_id_columns", provided_id_columns)
    query = {"entity_type": entity_type, "name_column": name_column, "provided_id_columns": ",".join(provided_id_columns), "annotation_mode": annotation_mode}
    if annotators is not None:
        reject_commas("annotators", annotators)
        query["annotators"] = ",".join(annotators)
    return query | ({} if vocab is None else {"vocab": vocab})


#: Lines that a dataset run holds at once, and seconds that it lets lines wait for more.
HELD_LINES, HELD_SECONDS = 20_000, 1.0


def map_dataset_file(
    path: str,
    lines: HttpTransport | Iterable[str],
    *,
    spark: SparkSession | None = None,
    strict: bool = False,
    summaries: bool = True,
    on_result: Callable[[Row], None] | None = None,
    progress: Progress = False,
    total_hint: int | None = None,
    stop: StopHandle | None = None,
    **query,
) -> DatasetRun:
    """Uploads a TSV or CSV file and reads the NDJSON answer as it comes.

    ``lines`` may be any iterable of NDJSON lines in place of the service. Lines
    become results in parts, which are written once and delivered before the next
    line is asked for: at first one line at a time, then twice as many, up to
    HELD_LINES or what came in HELD_SECONDS. The driver holds no more than one
    part. An error before the first result is raised; one after it ends the run,
    which then holds the results so far and the error; so does a stop. What the
    callback raises isn't caught: it ends the run and closes the answer.
    """
    spark = spark or SparkSession.active()
    if isinstance(lines, HttpTransport):
        lines = lines.dataset_lines(path, dataset_query(**query), content_type(path))
    out, error, at, size, held, shape = scratch_path(spark, "dataset"), None, 0, 1, [], None

    def parse(part: list[tuple[int, str]]) -> DataFrame:
        return from_ndjson(spark.createDataFrame(part, "ord long, value string"), strict=strict, summaries=summaries)

    def deliver() -> bool:
        """Writes and hands on the lines held; whether they made a result."""
        nonlocal held
        part, held = parse(held), []
        part.coalesce(1).write.mode("append").parquet(out)
        rows = part.orderBy("ord").collect() if on_result is not None or progress else []
        for row in rows:
            tick(1)
            if on_result is not None:
                on_result(row)
        return True

    shape = parse([]).schema
    walk = iter(lines)
    with ticking(progress, total_hint, "Mapping dataset") as tick, contextlib.ExitStack() as ended, tagged(spark, stop):
        if hasattr(walk, "close"):
            ended.callback(walk.close)
        began, any_result = time.monotonic(), False
        while True:
            if stop and stop.stopped:
                error = STOPPED
                break
            try:
                line = next(walk)
            except StopIteration:
                break
            except Exception as e:
                if not any_result and not held:
                    raise
                error = str(e) or type(e).__name__
                break
            if not line.strip():
                continue
            held.append((at, line))
            at += 1
            if len(held) >= size or time.monotonic() - began > HELD_SECONDS:
                any_result, size, began = deliver(), min(2 * size, HELD_LINES), time.monotonic()
        if held:
            deliver()
    results = spark.read.schema(shape).parquet(out) if at else spark.createDataFrame([], shape)
    return DatasetRun(results, error)


def list_catalog(name: str, transport: HttpTransport, *, spark: SparkSession | None = None) -> DataFrame:
    """entity-types, annotators or vocabularies of the service as a frame."""
    parse = {"entity-types": catalogs.entity_types, "annotators": catalogs.annotators, "vocabularies": catalogs.vocabularies}[name]
    payload = transport.catalog(name)
    json.loads(payload)
    return parse((spark or SparkSession.active()).createDataFrame([(payload,)], "payload string"))
