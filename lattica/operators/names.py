"""Names that hold one another, met by short pieces of them and not by a scan of all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import cut

GRAM = 3
#: Parts of up to this number are sent to every task that reads texts; of more, no table is sent whole.
SENT = 10_000


def _pieces(text: Column, n: int) -> Column:
    """The distinct pieces of n characters of a text."""
    at = F.sequence(F.lit(1), F.length(text) - n + 1)
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(at, lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def name_contains_match(texts: DataFrame, parts: DataFrame, part_id: str = "part_id", by: tuple[str, ...] = ()) -> DataFrame:
    """<by>, id, <part_id>: every pair of texts (<by>, id, name) and parts (<by>, <part_id>, name) of equal <by> where the text holds the part, in any case.

    A part meets the texts that hold the rarest of its pieces of GRAM characters (the whole part, if
    it is shorter), as counted over all texts; the pair is then checked. A part with a piece that no
    text has meets none. Blank parts are held by none.
    """
    t = texts.select(*by, "id", F.lower("name").alias("t"))
    p = parts.select(*by, part_id, F.lower("name").alias("p")).where(F.trim("p") != "")
    short = F.length("p") < GRAM
    held = p.agg(F.count("*").alias("n"), *[F.max((F.length("p") == n).cast("int")).alias(f"n{n}") for n in range(1, GRAM)]).first()
    lengths = [n for n in range(1, GRAM) if held[f"n{n}"]]  # pieces of these lengths only if there are such parts
    # a small file can hold many rows, so the number of parts decides and not the size that is expected of them
    way = "broadcast" if held["n"] <= SENT else "merge"
    grams = t.select(*by, "id", "t", F.explode(F.concat(*[_pieces(F.col("t"), n) for n in (*lengths, GRAM)])).alias("g"))
    counts = grams.groupBy(*by, "g").agg(F.count("*").alias("c"))
    asked = p.select(*by, part_id, "p", F.explode(F.when(short, F.array("p")).otherwise(_pieces(F.col("p"), GRAM))).alias("g"))
    known = asked.join(counts.hint("merge"), [*by, "g"], "left").groupBy(*by, part_id, "p").agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "g")).alias("r"))
    rare = known.where("r.c > 0").select(*by, part_id, "p", "r.g")
    return grams.join(rare.hint(way), [*by, "g"]).where(F.contains("t", "p")).select(*by, "id", part_id)


def partial_name_resolve(names: DataFrame, known: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """<by>, name, id, minted: what names (<by>, name, seq) of data mean among known ones (<by>, name, id, seq).

    An equal name wins, then the first known one that holds the name or is held by it. Of the others
    the first one in order gets an id of its own and counts as known, after the known ones, for those
    that come later: a name with its id then is what it holds or is held by. Names of one order are
    taken by the alphabet. Case and space at the ends do not count; blank names are left out. seq may
    be absent, then the alphabet alone is the order.
    """
    on = list(by)
    order = F.col("seq") if "seq" in names.columns else F.lit(0)
    n = cut(names.select(*by, "name", F.lower(F.trim("name")).alias("key"), order.cast("long").alias("seq")).where(F.col("key") != ""), "names")
    k = known.select(*by, F.lower("name").alias("known"), "id", "seq")
    keys = n.groupBy(*by, "key").agg(F.min("seq").alias("at"))
    far = lambda df: df.hint("merge")  # noqa: E731  names grow with the input, and their files are small for their number
    equal = keys.join(far(k.withColumnRenamed("known", "key")), [*on, "key"]).groupBy(*by, "key").agg(F.max_by("id", "seq").alias("id"))
    open_ = cut(keys.join(far(equal.select(*by, "key")), [*on, "key"], "left_anti"), "open-names")
    as_text, as_part = open_.select(*by, F.col("key").alias("id"), F.col("key").alias("name")), open_.select(*by, "key", F.col("key").alias("name"))
    within = name_contains_match(k.select(*by, F.struct("id", "seq").alias("id"), F.col("known").alias("name")), as_part, "key", by).select(*by, "key", "id.*")
    around = name_contains_match(as_text, k.select(*by, F.struct("id", "seq").alias("to"), F.col("known").alias("name")), "to", by).select(*by, F.col("id").alias("key"), "to.*")
    near = cut(within.unionByName(around).groupBy(*by, "key").agg(F.min_by("id", F.struct("seq", "id")).alias("id")), "near-names")
    # names that only meet each other: the first of those that hold one another mint, round by round
    left = cut(open_.join(far(near.select(*by, "key")), [*on, "key"], "left_anti"), "left-names")
    turn = left.select(*by, "key", F.struct("at", "key").alias("turn"))
    pair = name_contains_match(left.select(*by, F.col("key").alias("id"), F.col("key").alias("name")), left.select(*by, "key", F.col("key").alias("name")), "key", by).where("id <> key")
    both = pair.select(*by, "key", F.col("id").alias("other")).union(pair.select(*by, F.col("id"), F.col("key"))).distinct()
    both = both.join(far(turn), [*on, "key"]).join(far(turn.select(*by, F.col("key").alias("other"), F.col("turn").alias("before"))), [*on, "other"])
    earlier = cut(both.where("before < turn").select(*by, "key", "other", "before"), "earlier-names")
    minted, undecided = None, left.select(*by, "key")
    while True:
        waits = earlier.join(far(undecided.withColumnRenamed("key", "other")), [*on, "other"], "left_semi").select(*by, "key").distinct()
        new = cut(undecided.join(far(waits), [*on, "key"], "left_anti"), "minted-names")
        if new.isEmpty():
            break
        minted = new if minted is None else minted.unionByName(new)
        taken = earlier.join(far(new.withColumnRenamed("key", "other")), [*on, "other"], "left_semi").select(*by, "key").distinct()
        undecided = cut(undecided.join(far(new), [*on, "key"], "left_anti").join(far(taken), [*on, "key"], "left_anti"), "undecided-names")
    fresh = F.concat(F.lit("data_object:"), F.replace("key", F.lit(" "), F.lit("_")))
    minted = (minted if minted is not None else undecided).select(*by, "key", fresh.alias("id"))
    joined = earlier.join(far(minted.select(*by, F.col("key").alias("other"), "id")), [*on, "other"]).groupBy(*by, "key").agg(F.min_by("id", "before").alias("id"))
    old = equal.unionByName(near).unionByName(joined).withColumn("minted", F.lit(False))
    return n.select(*by, "name", "key").distinct().join(far(old.unionByName(minted.withColumn("minted", F.lit(True)))), [*on, "key"]).select(*by, "name", "id", "minted")
