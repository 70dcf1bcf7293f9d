"""Writing a run: results, candidates, links to what they supersede, conflicts with open cases, audit rows and pattern tallies, chunk by chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowkin.functions.text import hash_share
from rowkin.operators.blocking import by_rows
from rowkin.sources.commits import Store
from rowkin.sources.tables import audit_rows
from rowkin.storage import staged

RESULTS = "result_id string, run_id string, source_authority string, record_id string, decision string, provider_id string, confidence double, match_weight double, route string, reason string, call_key string, audit_sampled boolean, created_at timestamp"
CANDIDATES = "result_id string, provider_id string, rank int, kind string, vector array<int>, match_weight double, posterior double, blocks array<string>"
LINKS = "old_id string, new_id string, run_id string"
FLAGS = "case_id string, result_id string, run_id string"
AUDIT = "action string, entity_type string, entity_id string, actor string, before string, after string, run_id string"
PATTERNS = "run_id string, kind string, vector array<int>, n long"
SKIPPED = "run_id string, record_id string"
DECISIONS = "record_id string, decision string, provider_id string, confidence double, match_weight double, route string, reason string, call_key string"
TABLES = {"results": RESULTS, "candidates": CANDIDATES, "supersedes": LINKS, "flags": FLAGS, "audit": AUDIT, "patterns": PATTERNS, "skipped": SKIPPED}


def shaped(df: DataFrame, ddl: str) -> DataFrame:
    """The columns of a schema, in its types; a column that is not there is null."""
    fields = [c.split(" ") for c in ddl.split(", ")]
    return df.select(*((F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in fields))


def read(store: Store, name: str) -> DataFrame:
    return store.table(name, TABLES[name])


def current_results(store: Store, before: str | None = None) -> DataFrame:
    """Results that nothing supersedes; ``before``: as they were without that run."""
    results, links = read(store, "results"), read(store, "supersedes")
    if before is not None:
        results, links = results.where(F.col("run_id") != before), links.where(F.col("run_id") != before)
    return results.join(by_rows(links.select(F.col("old_id").alias("result_id"))), "result_id", "left_anti")


def live_cases(store: Store, cases: DataFrame, before: str | None = None) -> DataFrame:
    """Active cases with ``conflict_flag`` and ``conflict_result_id`` as the flags of runs leave them. cases: case_id, source_authority, record_id, result_id, status, conflict_flag."""
    flags = read(store, "flags")
    if before is not None:
        flags = flags.where(F.col("run_id") != before)
    last = flags.groupBy("case_id").agg(F.max("result_id").alias("conflict_result_id"))  # a case is flagged once
    joined = cases.where("status = 'ACTIVE'").join(by_rows(last), "case_id", "left")
    return joined.withColumn("conflict_flag", F.coalesce("conflict_flag", F.lit(False)) | F.col("conflict_result_id").isNotNull())


def identity(authority: Column, record: Column) -> Column:
    """A record is its key within its authority: a corrected row is the same record."""
    return F.struct(F.coalesce(authority, F.lit("")).alias("source_authority"), record.alias("record_id"))


def write_run(store: Store, run_id: str, decisions: DataFrame, candidates: DataFrame, records: DataFrame, cases: DataFrame, chunks: int = 8, audit_rate: float = 0.0, created_at: Column | None = None) -> dict[str, int]:
    """Records a run's decisions and returns its counts; a run that was broken off goes on with the chunks it lacks.

    decisions: the columns of ``DECISIONS``, null where absent; candidates: record_id and the columns of ``CANDIDATES``; records: record_id, source_authority of the run's scope; cases: see
    ``live_cases``. Every chunk is one commit of all tables and compares with the state without this run, so the order
    of chunks and what an earlier attempt left do not matter; result ids are hashes, so a repeated run gives equal rows.
    A new result supersedes the current one of its record. Where that one differs in decision or provider, each active
    case of the record that is not flagged yet is flagged, with an audit row. Decisions of a model get an audit row.
    Rejected records that have candidates are drawn into the audit by the hash of run and record. Decisions on unknown
    records are kept as skipped. Two authorities that share a record key in one scope are refused: decisions name records by key alone.
    """
    scope = records.select("record_id", F.coalesce("source_authority", F.lit("")).alias("source_authority"))
    shared = scope.groupBy("record_id").count().where("count > 1").orderBy("record_id").limit(10).collect()
    if shared:
        raise ValueError(f"record keys shared by several rows of the scope: {', '.join(str(r[0]) for r in shared)}")
    missing = [k for k in range(chunks) if f"run:{run_id}:{k}:{chunks}" not in store.tags()]
    if missing:
        known = shaped(decisions, DECISIONS).join(by_rows(scope), "record_id", "left")
        has = candidates.select("record_id").distinct().withColumn("_has", F.lit(True))
        rows = known.join(by_rows(has), "record_id", "left").withColumn("_k", F.pmod(F.xxhash64("record_id"), F.lit(chunks))).where(F.col("_k").isin(missing))
        drawn = (F.col("decision") == "NO_MATCH") & F.coalesce("_has", F.lit(False)) & (hash_share(F.lit(f"{run_id}:"), F.col("record_id").cast("string")) < audit_rate)
        rows = rows.withColumn("audit_sampled", drawn).withColumn("run_id", F.lit(run_id)).withColumn("created_at", created_at if created_at is not None else F.current_timestamp())
        rows = staged(rows, "decided")
        # Ids are hashes of what rows hold: they are made where rows are written and do not travel.
        named = lambda df: df.withColumn("result_id", F.left(F.sha2(F.concat_ws("\x1f", F.lit(run_id), "source_authority", F.col("record_id").cast("string")), 256), F.lit(32)))
        met = rows.where("source_authority is not null")
        listed = staged(candidates.join(by_rows(met.select("record_id", "source_authority", "_k")), "record_id"), "listed")
        past = current_results(store, run_id).select("source_authority", "record_id", F.col("result_id").alias("old_id"), F.col("decision").alias("_d"), F.col("provider_id").alias("_p"))
        replaced = staged(met.select("source_authority", "record_id", "decision", "provider_id", "_k").join(by_rows(past), ["source_authority", "record_id"]), "replaced")
        open_cases = live_cases(store, cases, run_id).where("not conflict_flag").select("case_id", F.coalesce("source_authority", F.lit("")).alias("source_authority"), "record_id")
        differs = ~(F.col("decision").eqNullSafe(F.col("_d")) & F.col("provider_id").eqNullSafe(F.col("_p")))
        flagged = staged(replaced.where(differs).join(by_rows(open_cases), ["source_authority", "record_id"]), "flagged")
        for k in missing:
            of = lambda df: named(df.where((F.col("_k") == k) & F.col("source_authority").isNotNull())).withColumn("run_id", F.lit(run_id))  # noqa: B023, E731
            own, after, hit, pairs = of(rows), of(replaced), of(flagged), of(listed)
            said = lambda d, p, r, *more: F.struct(F.col(d).alias("decision"), F.col(p).alias("provider_id"), F.col(r).alias("result_id"), *more)
            by_model = audit_rows(own.where("route = 'LLM'"), "match.ai_decided", "match_result", F.col("result_id"), F.lit(None).cast("struct<decision:string>"), said("decision", "provider_id", "result_id", F.col("confidence"), F.col("call_key")))
            by_conflict = audit_rows(hit, "case.conflict_flagged", "case", F.col("case_id"), said("_d", "_p", "old_id"), said("decision", "provider_id", "result_id"))
            tables = {
                "results": own,
                "candidates": pairs,
                "supersedes": after.select("old_id", F.col("result_id").alias("new_id"), "run_id"),
                "flags": hit.select("case_id", "result_id", "run_id"),
                "audit": by_model.unionByName(by_conflict).withColumn("run_id", F.lit(run_id)),
                "patterns": pairs.groupBy("kind", "vector").agg(F.count("*").alias("n")).withColumn("run_id", F.lit(run_id)),
                "skipped": rows.where((F.col("_k") == k) & F.col("source_authority").isNull()),
            }
            store.commit(f"run:{run_id}:{k}:{chunks}", append={n: shaped(df, TABLES[n]) for n, df in tables.items()})
    return counts(store, run_id)


def counts(store: Store, run_id: str) -> dict[str, int]:
    """What a run has written so far."""
    own = lambda name: read(store, name).where(F.col("run_id") == run_id)
    n = lambda df, name: df.agg(F.count("*").alias(name))
    one = own("results").agg(F.count("*").alias("results"), F.count_if("audit_sampled").alias("audited"), F.count_if(F.col("route") == "LLM").alias("ai_decisions"))
    for name, label in (("supersedes", "superseded"), ("flags", "conflicts"), ("skipped", "skipped_unknown")):
        one = one.join(n(own(name), label))  # one row each
    return one.first().asDict()


def tally(store: Store, run_id: str) -> DataFrame:
    """The run's pattern tally (kind, vector, n), added up over its chunks."""
    return read(store, "patterns").where(F.col("run_id") == run_id).groupBy("kind", "vector").agg(F.sum("n").alias("n"))
