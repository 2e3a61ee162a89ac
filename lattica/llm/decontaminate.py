"""Benchmark decontamination: one Aho-Corasick automaton over the windows of normalised test items.

Texts and items are normalised alike: A-Z become lower case, words are what stands between other
ASCII characters than letters and digits. Windows of ``size`` consecutive words of an item (the item
whole, if it is shorter) are the automaton's patterns, words are its letters. A text is scanned
once; hit words are mapped back to code points of the original text. Windows and the items that
hold them are counted first: up to ``most`` bytes make one automaton that is sent to the tasks,
beyond that they are dealt to as many automata as need be, each at most that large, and what these
find in a text is united. Texts stay where they are.

Null texts and texts without words have no words and no hits; items without words are none. Items
are told apart by id; a null id is one item that is written as an empty string. Repeated rows count
as one item and as documents each. Long texts are scanned whole. Empty tables give no rows, or no
hits. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, written

SIZE = 10
#: Bytes of windows and item ids in one automaton.
MOST = 16 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word after lower-casing, and one of the original text.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ORIGINAL = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: The same for bytes of UTF-8: other ASCII characters become spaces, larger bytes stay.
_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def normalised(text: Column) -> Column:
    """The words of a text in lower case; none for null."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def byte_words(text: bytes | None) -> list[bytes]:
    return text.translate(_BYTES).split() if text else []


def windows(items: DataFrame, *, id_col: str = "item_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """item, window: the distinct windows of each item."""
    w = F.col("w")
    n = F.size(w)
    cut_ = F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, F.lit(size)), " "))
    taken = items.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("item"), normalised(F.col(f"`{text_col}`")).alias("w")).where(n > 0)
    return taken.select("item", F.explode(cut_).alias("window")).distinct()


class Windows:
    """The automaton of (window, item) rows. hits(words): word ranges of all occurrences, and the items that hold them."""

    def __init__(self, rows: list[tuple[str, str]]):
        import ahocorasick

        self.number: dict[bytes, int] = {}
        held: dict[tuple[int, ...], list[str]] = {}
        for window, item in rows:
            held.setdefault(tuple(self.number.setdefault(w, len(self.number) + 1) for w in window.encode().split(b" ")), []).append(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, items in held.items():
            self.automaton.add_word(key, (len(key), items))
        self.empty = not held
        if held:
            self.automaton.make_automaton()

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        if self.empty or not words:
            return [], set()
        get = self.number.get
        ranges: list[tuple[int, int]] = []
        found: set[str] = set()
        seen: set[int] = set()
        for end, (n, items) in self.automaton.iter(tuple([get(w, 0) for w in words])):
            a = end + 1 - n
            while ranges and ranges[-1][0] >= a:  # ends ascend: what starts later lies within
                ranges.pop()
            if ranges and ranges[-1][1] >= a:
                ranges[-1] = (ranges[-1][0], end + 1)
            else:
                ranges.append((a, end + 1))
            if id(items) not in seen:
                seen.add(id(items))
                found.update(items)
        return ranges, found


def united(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code points (start, end) of word ranges, which ascend and don't overlap."""
    if not ranges:
        return []
    at = [m.span() for m in _ORIGINAL.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in ranges]


_open: dict[str, Windows] = {}


def _opened(sent) -> Windows:
    """The automaton of (key, broadcast rows); one at a time in each worker process."""
    key, rows = sent
    if key not in _open:
        _open.clear()
        _open[key] = Windows(rows.value)
    return _open[key]


_RANGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
RANGES = "array<struct<start:bigint,end:bigint>>"


def _pairs(ranges):
    return [{"start": a, "end": b} for a, b in ranges]


def _report(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """sent: the automaton, or None if rows come with their ranges and items."""
    for batch in batches:
        n_words, n_hit, at, names = [], [], [], []
        for k, value in enumerate(batch.column("text")):
            text = value.as_py()
            words = byte_words(text)
            if sent:
                ranges, items = _opened(sent).hits(words)
            else:
                ranges = united([(r["start"], r["end"]) for r in batch.column("ranges")[k].as_py() or ()])
                items = batch.column("items")[k].as_py() or ()
            n_words.append(len(words))
            n_hit.append(sum(b - a for a, b in ranges))
            at.append(_pairs(spans(text.decode(), ranges)) if ranges else [])
            names.append(sorted(set(items)))
        yield pa.record_batch([batch.column("id"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(at, _RANGES)], ["id", "n_words", "n_hit", "items", "spans"])


def _found(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(rid, *_opened(sent).hits(byte_words(text))) for rid, text in zip(batch.column("rid").to_pylist(), batch.column("text").to_pylist(), strict=True)]
        rows = [r for r in rows if r[1]]
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([_pairs(r[1]) for r in rows], _RANGES), pa.array([sorted(r[2]) for r in rows], pa.list_(pa.string()))], ["rid", "ranges", "items"])


def contamination(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = SIZE, most: int = MOST) -> DataFrame:
    """<id>, n_words, n_hit, items (ids of the items that the text holds a window of, sorted as strings), spans (code points of hit words in a row)."""
    spark = docs.sparkSession
    found = written(windows(items, id_col=item_col, text_col=item_text_col, size=size), "windows")
    total = found.agg(F.coalesce(F.sum(F.octet_length("window") + F.octet_length("item") + 64), F.lit(0)).alias("n")).head()["n"]
    blocks = max(1, -(-total // most))
    # a window that many items hold goes to the blocks with them
    block = F.pmod(F.xxhash64("window", "item"), F.lit(blocks))
    sent = lambda b: (uuid4().hex, spark.sparkContext.broadcast([(r["window"], r["item"]) for r in found.where(block == b).select("window", "item").toLocalIterator()]))  # noqa: E731  most bytes on average
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    out = f"id {slim.schema['id'].dataType.simpleString()}, n_words bigint, n_hit bigint, items array<string>, spans {RANGES}"
    if blocks == 1:
        one = sent(0)
        return slim.mapInArrow(lambda batches: _report(batches, one), out).withColumnRenamed("id", id_col)
    slim = written(slim.withColumn("rid", F.monotonically_increasing_id()), "texts")
    parts = []
    for b in range(blocks):
        one = sent(b)
        parts.append(written(slim.select("rid", "text").mapInArrow(lambda batches, one=one: _found(batches, one), f"rid bigint, ranges {RANGES}, items array<string>"), "hits"))
        one[1].unpersist()
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    hits = hits.groupBy("rid").agg(F.flatten(F.collect_list("ranges")).alias("ranges"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return slim.join(hits, "rid", "left").select("id", "text", "ranges", "items").mapInArrow(lambda batches: _report(batches, None), out).withColumnRenamed("id", id_col)


def op12_benchmark_decontamination(spark, sf_dir):
    got = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), i AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), p AS (
  SELECT DISTINCT item, least(len(w), 10) AS size, w[pos + 1] AS head, array_to_string(w[pos + 1:pos + 10], ' ') AS win
  FROM (SELECT *, unnest(range(greatest(len(w) - 9, 1))) AS pos FROM i WHERE len(w) > 0)
), x AS (SELECT rid, w, unnest(range(len(w))) AS pos FROM d
), c AS (SELECT rid, w, pos FROM x WHERE w[pos + 1] IN (SELECT head FROM p)
), h AS MATERIALIZED (
  SELECT c.rid, c.pos, p.size, p.item
  FROM (SELECT rid, pos, size, array_to_string(w[pos + 1:pos + size], ' ') AS win FROM c, (SELECT DISTINCT size FROM p) WHERE pos + size <= len(w)) c JOIN p USING (size, win)
), k AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(pos, pos + size)) AS word FROM h) GROUP BY rid
), n AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN k USING (rid) LEFT JOIN n USING (rid)
"""
