"""Token counts of fields or sections, from one encoding of the whole document.

A document is encoded once; each token's byte span is mapped to the sections' spans by an
interval join (both are sorted, so it is a binary search of section starts). A token that
crosses a border goes by an explicit rule:

* ``start``: to the section that holds its first byte;
* ``end``: to the section that holds its last byte;
* ``most``: to the section that holds most of its bytes, the earlier one on a tie.

Each rule gives every token to one section, so the sections of a document sum to its tokens.
Sections are the stretches of a text up to and with each ``sections`` string (a line end, say), so
they cover it without gaps. Null and empty texts have one section without tokens. Repeated rows
are counted each, ids may be null or repeated, and further columns are ignored. Very long texts are
encoded whole; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .tokens import default_path, encoder

SCHEMA = "section int, start long, length long, n_tokens long, n_crossing long"


def attribute(lengths: np.ndarray, cuts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section and those of them that cross a border; lengths: bytes of each token, cuts: the sections' byte borders from 0 to the end."""
    stop = np.cumsum(lengths)
    start = stop - lengths
    first = np.searchsorted(cuts, start, "right") - 1
    last = np.searchsorted(cuts, stop - 1, "right") - 1
    crosses = first != last
    to = first if rule == "start" else last
    if rule == "most":
        to = first.copy()
        for i in np.flatnonzero(crosses):
            s = np.arange(first[i], last[i] + 1)
            to[i] = s[np.argmax(np.minimum(cuts[s + 1], stop[i]) - np.maximum(cuts[s], start[i]))]
    n = len(cuts) - 1
    return np.bincount(to, minlength=n), np.bincount(to[crosses], minlength=n)


def count_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, rule: str = "start", sections: str = "\n") -> DataFrame:
    """A row for each section: id, section (from 0), start and length (code points), n_tokens, n_crossing. sections: what ends a section; it belongs to the section that it ends."""
    if rule not in ("start", "end", "most"):
        raise ValueError(f"no such rule: {rule}")
    path = tokenizer or default_path()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        enc = encoder(path)
        size, end = enc.byte_lengths(), sections.encode()
        for pdf in batches:
            rows: dict[str, list] = {k: [] for k in ("id", "section", "start", "length", "n_tokens", "n_crossing")}
            for lo in range(0, len(pdf), 64):
                part = pdf.iloc[lo : lo + 64]
                texts = [x or "" for x in part["text"]]
                for key, text, ids in zip(part["id"], texts, enc.ids(texts), strict=True):
                    raw = text.encode()
                    parts = raw.split(end)
                    sizes = np.array([len(x) + len(end) for x in parts], "i8")
                    sizes[-1] -= len(end)
                    chars = np.array([len(x) for x in text.split(sections)], "i8") + len(sections)
                    chars[-1] -= len(sections)
                    cuts = np.concatenate(([0], np.cumsum(sizes)))
                    n, crossing = attribute(size[np.frombuffer(ids, "<u4")], cuts, rule)
                    k = len(parts)
                    rows["id"] += [key] * k
                    rows["section"] += range(k)
                    rows["start"] += (np.cumsum(chars) - chars).tolist()
                    rows["length"] += chars.tolist()
                    rows["n_tokens"] += n.tolist()
                    rows["n_crossing"] += crossing.tolist()
            out = pd.DataFrame(rows)
            out["id"] = pd.Series(rows["id"], dtype=object)
            yield out

    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return slim.mapInPandas(run, f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)


def op3_token_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"))
