"""Secret scans with an incremental blob ledger (operator 12).

Every version of every path is addressed by its content: its blob is the SHA-256 of its text. The ledger is a table of what has been scanned: for a blob, the
rule versions that have seen it, and what they have found. A scan takes only the pairs of blob and rule version that the ledger lacks, and
each blob once, however many paths and versions hold it; findings are then joined back to all paths by their blobs. New paths of
known text, moved files and restored versions cost no scan, and a new version of a rule scans every blob for that rule alone.

Copies of a blob are combined inside each task before the shuffle, so a text that a third of all paths hold is no hot key. When few blobs are
unseen (FEW at most, 32 bytes each), they are broadcast and only their texts move; else texts are dealt by blob. The way back
to the paths broadcasts the findings of the most frequent blobs (HOT_KEYS at most, of at most HOT_FOUND findings each); the others are joined by blob.

Defined cases: a null text is empty and has no findings; a null path column is a path like any other; repeated rows give a result each; very long texts are
scanned whole, in time in proportion to their length; overlapping findings of different rules all stand, in the order of start, then of the rules, then of end; an
empty table gives an empty result; columns other than those named are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from cytoplan.llm.common import HOT_KEYS, HOT_ROWS, written


@dataclass(frozen=True)
class Rule:
    """A pattern, matched from left to right without overlap; matches whose part has fewer than least characters are dropped.

    A changed pattern needs a new version: findings of other versions are not reported.
    """

    kind: str
    version: int
    pattern: str
    part: int = 0
    least: int = 0
    any_case: bool = False
    hint: str = ""  # stands in every match

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The base rules, then public formats of credentials.
BASE = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, False, "AKIA"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),  # shorter runs have no match that could be dropped
)
RULES = (
    *BASE,
    Rule("private_key", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]+-----END [A-Z ]{0,40}PRIVATE KEY-----)?", 0, 0, False, "PRIVATE KEY-----"),
    Rule("web_token", 1, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0, False, "eyJ"),
    Rule("code_host", 1, r"(?<![A-Za-z0-9_])gh[oprsu]_[A-Za-z0-9]{36,}", 0, 0, False, "gh"),
    Rule("chat", 1, r"(?<![A-Za-z0-9-])xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0, False, "xox"),
    Rule("url_password", 1, r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,256}:[^\s:/@]{1,256}@", 0, 0, False, "://"),
)
#: Unseen blobs that are broadcast at most; findings that a broadcast blob has at most.
FEW, HOT_FOUND = 100_000, 1000
LEDGER = "blob binary, scanned array<string>, found array<struct<rule:string,start:int,end:int>>"
_FOUND = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


@lru_cache(256)
def _compiled(rule: Rule) -> re.Pattern:
    return re.compile(rule.pattern, re.A | re.I if rule.any_case else re.A)


def spans(text: str, rule: Rule) -> list[tuple[int, int]]:
    """Start and end, in code points, of every finding of a rule."""
    if rule.hint not in text:
        return []
    return [m.span() for m in _compiled(rule).finditer(text) if m.end(rule.part) - m.start(rule.part) >= rule.least]


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _scanned(batches: Iterator[pa.RecordBatch], rules: tuple[Rule, ...]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for text, todo in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            text = text.as_py()
            found.append([{"rule": r.key, "start": a, "end": b} for r in rules if r.key in todo for a, b in spans(text, r)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, _FOUND)], names=["blob", "scanned", "found"])


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """What to add to the ledger: a row for each blob of versions (text) that some of the rules have not seen.

    ledger: what earlier scans have returned, all together; it may hold several rows of a blob.
    """
    if len({r.kind for r in rules}) < len(rules):
        raise ValueError("a rule can be used in one version at a time")
    every = F.array(*(F.lit(r.key) for r in rules))
    texts = versions.select(blob_of(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    if ledger is not None:
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("scanned"))).alias("seen"))
        todo = texts.select("blob").distinct().join(seen, "blob", "left")
        todo = todo.select("blob", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo")).where(F.size("todo") > 0)
        todo = written(todo, "unseen")
        if todo.count() <= FEW:
            texts = texts.join(F.broadcast(todo.select("blob")), "blob", "left_semi")
    once = texts.groupBy("blob").agg(F.first("text").alias("text"))
    once = once.withColumn("todo", every) if ledger is None else once.join(todo, "blob")
    return once.select("blob", "text", "todo").mapInArrow(lambda b: _scanned(b, rules), LEDGER)


def findings(versions: DataFrame, ledger: DataFrame, *paths: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The path columns of every version, and found: an array of (start, at, end, kind) in their order; at is the rule's place.

    versions: the path columns and text. Only findings of the given rule versions are reported.
    """
    keys, kinds = F.array(*(F.lit(r.key) for r in rules)), F.array(*(F.lit(r.kind) for r in rules))
    at = {f"p{i}": F.col(p) for i, p in enumerate(paths)}
    rows = versions.select(blob_of(F.col("text")).alias("blob"), *(c.alias(n) for n, c in at.items()))
    own = F.filter("found", lambda x: F.array_contains(keys, x["rule"]))
    known = ledger.select("blob", own.alias("found")).where(F.size("found") > 0).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))

    def sorted_found(found: Column) -> Column:
        place = lambda x: F.array_position(keys, x["rule"]).cast("int")
        return F.array_sort(F.transform(found, lambda x: F.struct(x["start"].alias("start"), place(x).alias("at"), x["end"].alias("end"), F.element_at(kinds, place(x)).alias("kind"))))

    known = written(known.select("blob", sorted_found(F.col("found")).alias("found")), "found")
    # Blobs that many paths hold, with findings or without: their paths are not dealt by blob.
    none = F.array().cast(known.schema["found"].dataType)
    copies = rows.groupBy("blob").count().where(F.col("count") > HOT_ROWS).join(known, "blob", "left").withColumn("hot", F.coalesce("found", none))
    hot = copies.where(F.size("hot") <= HOT_FOUND).orderBy(F.desc("count"), "blob").limit(HOT_KEYS).select("blob", "hot")
    rows = rows.join(F.broadcast(written(hot, "hot")), "blob", "left")
    columns = [F.col(n).alias(p) for n, p in zip(at, paths, strict=True)]
    some = rows.where("hot IS NOT NULL").select(*columns, F.col("hot").alias("found"))
    others = rows.where("hot IS NULL").drop("hot").join(known, "blob", "left").select(*columns, F.coalesce("found", none).alias("found"))
    return some.unionByName(others)


def digests(found: DataFrame, *paths: str) -> DataFrame:
    """The path columns, counts of the base kinds, base_sha256 and spans."""
    base = [r.kind for r in BASE]
    text = lambda spans: F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        *paths, *(count(k).alias(f"n_{k}") for k in base),
        F.sha2(text(F.filter("found", lambda x: x["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"), text(F.col("found")).alias("spans"),
    )
