"""Secret scan with corpus-wide ownership frequency.  Native column expressions only.

Candidates are hashed and counted by distinct repositories and owners over the whole corpus.  A value that
many owners share, or some owners in many repositories, is a copied example; a live-looking value that one
owner alone has, in however many repositories, is reported as a secret of that owner, also where none of the
plain patterns sees it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Maximal runs that could be a bare credential; they count only if they also look live.
BARE = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}"
#: Kind, pattern, group that holds the value, least length of the value; in the order of reports.
KINDS = (("assign", ASSIGN, 1, 8), ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]{32,}", 0, 32), ("owned", BARE, 0, 20))
BASE_KINDS = 3
#: Owners from which a value counts as a widely copied example.
WIDE_OWNERS = 3
#: Repositories from which a value of more than one owner does.
WIDE_REPOS = 5
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|changeme|your[_-]|xxxx|test|0123456789|1234567890"
MIN_DISTINCT_CHARS = 10


def looks_live(value: Column) -> Column:
    """Letters and digits, many different characters, and no placeholder wording."""
    kinds = F.size(F.array_distinct(F.split(value, "")))
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (kinds >= MIN_DISTINCT_CHARS) & ~value.rlike(PLACEHOLDER)


def _hits(text: Column, pattern: str) -> Column:
    """Array of ``(gap, hit)``: code points between hits, and the hits, leftmost and non-overlapping."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    return F.when(text.rlike(pattern), F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit")))


def scan(docs: DataFrame, key: str, owner: str, repo: list[str], text: str, name: str = "secrets") -> DataFrame:
    """One pass over the texts.  Table ``_row, _key, _owner, _repo, _found``; ``_found`` has the hits of
    all kinds and is null where there are none."""
    body = F.coalesce(F.col("_text"), F.lit(""))
    narrow = docs.select(F.col(key).alias("_key"), F.col(owner).alias("_owner"), F.struct(*repo).alias("_repo"), F.col(text).alias("_text"))
    found = [F.coalesce(_hits(body, pattern), F.array().cast("array<struct<gap:int,hit:string>>")) for _, pattern, _, _ in KINDS]
    rows = narrow.select("_key", "_owner", F.to_json("_repo").alias("_repo"), F.array(*found).alias("_found"))
    rows = rows.withColumn("_found", F.when(F.exists("_found", lambda x: F.size(x) > 0), F.col("_found")))
    return cut(rows.withColumn("_row", F.monotonically_increasing_id()), name)


def spans(found: DataFrame) -> DataFrame:
    """``_row, _owner, _repo, kind, start, stop, value``: spans in code points that pass their length."""
    by_kind = found.where("_found IS NOT NULL").select("_row", "_owner", "_repo", F.posexplode("_found").alias("kind", "_hits"))
    each = by_kind.select("_row", "_owner", "_repo", "kind", F.posexplode("_hits").alias("i", "h"))
    each = each.select("_row", "_owner", "_repo", "kind", "i", F.col("h.gap").alias("gap"), F.col("h.hit").alias("hit"))
    # a window over the hits of one text and kind
    stop = F.sum(F.col("gap") + F.length("hit")).over(Window.partitionBy("_row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    value = F.when(F.col("kind") == 0, F.regexp_extract("hit", ASSIGN, 1)).otherwise(F.col("hit"))
    each = each.select("_row", "_owner", "_repo", "kind", stop.alias("stop"), F.length("hit").alias("n"), value.alias("value"))
    least = F.element_at(F.array(*[F.lit(k[3]) for k in KINDS]), F.col("kind") + 1)
    each = each.where((F.length("value") >= least) & ((F.col("kind") < BASE_KINDS) | looks_live(F.col("value"))))
    return each.select("_row", "_owner", "_repo", "kind", (F.col("stop") - F.col("n")).alias("start"), "stop", F.sha2("value", 256).alias("hash"), looks_live(F.col("value")).alias("live"))


def ownership(candidates: DataFrame) -> DataFrame:
    """``hash, n_owners, n_repos, n_uses``: a value's distinct owners and their repositories.

    Three group-bys that each combine before their shuffle, so a value that a third of all rows hold
    costs one row for each task and owner.  A null owner is an owner of its own."""
    by_repo = candidates.groupBy("hash", "_owner", "_repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("hash", "_owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n_uses"))


def secret_scan(docs: DataFrame, key: str = "doc_id", owner: str = "source", repo: tuple[str, ...] = ("source", "lang"), text: str = "text", wide_owners: int = WIDE_OWNERS, wide_repos: int = WIDE_REPOS) -> DataFrame:
    """One row per input row: ``key, spans``, an array of ``struct(start, kind, stop, hash, verdict,
    n_owners, n_repos)`` by start, then kind.

    Base kinds (``assign``, ``access``, ``hex``) always stay.  An ``owned`` span is added where a bare
    live-looking run meets no base span and one owner alone has its value.  ``verdict`` is ``copied``
    for values of ``wide_owners`` owners or more, or of at least two owners in ``wide_repos`` repositories,
    ``live`` for live-looking values of one owner, else ``shared``.  Null and empty texts have no spans;
    texts of any length are read whole, in one pass of their row; spans that start together are ordered by
    kind; repeated rows are rows, and count once among owners and repositories; a null owner is one owner; an
    empty table gives an empty one."""
    found = scan(docs, key, owner, list(repo), text)
    each = cut(spans(found), "secret-spans")
    owners = cut(ownership(each), "secret-owners")
    joined = each.join(owners, "hash")
    verdict = F.when((F.col("n_owners") >= wide_owners) | ((F.col("n_owners") > 1) & (F.col("n_repos") >= wide_repos)), "copied").when((F.col("n_owners") == 1) & F.col("live"), "live").otherwise("shared")
    joined = joined.withColumn("verdict", verdict).where((F.col("kind") < BASE_KINDS) | (F.col("verdict") == "live"))
    # added spans must not meet a base span: compare with the furthest base end before and the next base start
    base_stop, base_start = F.when(F.col("kind") < BASE_KINDS, F.col("stop")), F.when(F.col("kind") < BASE_KINDS, F.col("start"))
    before = F.max(base_stop).over(Window.partitionBy("_row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(base_start).over(Window.partitionBy("_row").orderBy(F.desc("start"), F.asc("kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    clear = (F.coalesce(before, F.lit(0)) <= F.col("start")) & (F.coalesce(after, F.col("stop")) >= F.col("stop"))
    joined = joined.withColumn("_clear", clear).where((F.col("kind") < BASE_KINDS) | F.col("_clear"))
    item = F.struct("start", "kind", "stop", "hash", "verdict", "n_owners", "n_repos")
    grouped = joined.groupBy("_row").agg(F.sort_array(F.collect_list(item)).alias("spans"))  # of one text
    # only rows with hits take part in the join; the rest have no spans
    some = found.where("_found IS NOT NULL").select("_row", "_key").join(grouped, "_row", "left")
    none = found.where("_found IS NULL").select("_key", F.lit(None).cast(grouped.schema["spans"].dataType).alias("spans"))
    out = some.select("_key", "spans").unionByName(none)
    empty = F.array().cast(grouped.schema["spans"].dataType)
    return out.select(F.col("_key").alias(key), F.coalesce("spans", empty).alias("spans"))


def redact(text: Column, found: Column) -> Column:
    """``text`` with every span replaced; overlapping spans are replaced once, by the first one's mark."""
    marks = F.create_map(F.lit("live"), F.lit("[SECRET]"), F.lit("shared"), F.lit("[SECRET]"), F.lit("copied"), F.lit("[EXAMPLE SECRET]"))

    def step(acc: Column, s: Column) -> Column:
        added = F.concat(acc["out"], F.substr(text, acc["end"] + 1, s["start"] - acc["end"]), F.element_at(marks, s["verdict"]))
        fresh = s["start"] >= acc["end"]
        return F.struct(F.when(fresh, added).otherwise(acc["out"]).alias("out"), F.greatest(acc["end"], s["stop"]).alias("end"))

    done = F.aggregate(found, F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("end")), step)
    return F.concat(done["out"], F.substr(text, done["end"] + 1))


def span_text(spans_: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"])), ",")


def secret_digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"] < BASE_KINDS)

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def judged(verdict: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["verdict"] == verdict)).cast("long")

    def most(field: str) -> Column:
        return F.coalesce(F.array_max(F.transform("spans", lambda s: s[field])), F.lit(0)).cast("long")

    return found.select(
        key, count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"),
        count(3).alias("n_owned"), judged("live").alias("n_live"), judged("copied").alias("n_copied"), most("n_owners").alias("most_owners"), most("n_repos").alias("most_repos"),
    )


def _hits_sql(kind: int) -> str:
    pattern, group = KINDS[kind][1].replace("(?<![A-Za-z0-9_-])", "").replace("'", "''"), KINDS[kind][2]
    return f"""SELECT r, owner, repo, {kind} AS kind, regexp_extract_all(text, '{pattern}', 0) AS hits, regexp_extract_all(text, '{pattern}', {group}) AS vals,
    list_transform(regexp_split_to_array(text, '{pattern}'), lambda x: length(x)) AS gaps FROM d"""


#: The digests of ``secret_digest``.  A run of 20 or more begins where it can, so the look-behind (which SQL's
#: patterns lack) changes nothing.
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, source AS owner, [source, lang] AS repo FROM documents),
found AS ({" UNION ALL ".join(_hits_sql(k) for k in range(len(KINDS)))}),
each AS (SELECT r, owner, repo, kind, i, hits[i] AS hit, vals[i] AS val,
    (list_sum(gaps[1:i]) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))::BIGINT AS lo
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM found)),
fit AS (SELECT r, owner, repo, kind, lo, lo + length(hit) AS hi, sha256(val) AS hash,
    regexp_matches(val, '[0-9]') AND regexp_matches(val, '[A-Za-z]') AND len(list_distinct(string_split(val, ''))) >= {MIN_DISTINCT_CHARS} AND NOT regexp_matches(val, '{PLACEHOLDER}') AS live
  FROM each WHERE length(val) >= CASE kind {" ".join(f"WHEN {i} THEN {k[3]}" for i, k in enumerate(KINDS))} END),
known AS (SELECT * FROM fit WHERE kind < {BASE_KINDS} OR live),
owners AS (SELECT hash, count(DISTINCT coalesce(owner, chr(0))) AS n, count(DISTINCT repo) AS repos FROM known GROUP BY hash),
judged AS (SELECT k.*, n, repos, CASE WHEN n >= {WIDE_OWNERS} OR n > 1 AND repos >= {WIDE_REPOS} THEN 'copied' WHEN n = 1 AND live THEN 'live' ELSE 'shared' END AS verdict FROM known k JOIN owners USING (hash)),
kept AS (SELECT * FROM judged j WHERE kind < {BASE_KINDS} OR verdict = 'live' AND NOT EXISTS (FROM judged b WHERE b.r = j.r AND b.kind < {BASE_KINDS} AND b.lo < j.hi AND b.hi > j.lo)),
named AS (SELECT *, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || lo || ':' || hi AS span FROM kept)
SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY lo, kind) FILTER (kind < {BASE_KINDS}), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY lo, kind), '') AS spans,
  count(*) FILTER (kind = 3) AS n_owned, count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'copied') AS n_copied, coalesce(max(n), 0) AS most_owners, coalesce(max(repos), 0) AS most_repos
FROM d LEFT JOIN named USING (r) GROUP BY r, doc_id
"""
