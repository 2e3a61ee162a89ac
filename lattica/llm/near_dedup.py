"""Near-duplicate classes by Order MinHash.

Texts that are equal are one node. Of a node's k-word shingles, each labelled with how often it
occurred before, every one of ``sketches`` hash orders picks the ``picks`` smallest and keeps them
in text order; equal picks make a bucket. Every text has further sketches of fewer picks of shorter
shingles, for links whose edits are scattered. Unlike plain MinHash this is sensitive to the order of
the text, so to edit similarity. Candidates are verified by a banded alignment of words: linked if
``1 - distance / longer length`` is ``similarity`` or more.

A bucket of near copies never emits all its pairs. First its members are compared with one leader, and components
of those links are formed. A later comparison is only of use between components, so in buckets that
hold several, the leader's component meets the other members, and those meet each other; pairs of
one component never do. Exact filters stand before every alignment: the ratio of lengths, and
the parities of hashed words, each labelled with how often
it occurred before, of which one edit changes two at most; between components also those of a map
that grows with the text, and the words and word pairs in common. No pair of a bucket that could link two components is left out. In a
bucket of many components every two members are still compared by these maps, though only what
passes is emitted; see the README.

Null and empty texts are equal texts. Texts of fewer than k words have one shingle of all their
words. A class is named by its smallest id; null ids only name a class without others. Of rows that
repeat id and text, one stays. Columns other than id and text pass through. An empty table stays empty.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, small_batches, sweep, table, written

K, SKETCHES, PICKS, SIMILARITY = 5, 32, 3, 0.8
#: 64-bit words of the parity map.
PARITY = 8
#: Further sketches of every text: edits scattered over a fifth of the words leave 5-word shingles an
#: overlap of 0.2, so 22 % of such pairs share one of 32 sketches of 3; of 3-word ones 0.34, and with 24 sketches of 2 it is 95 %.
MORE_K, MORE_SKETCHES, MORE_PICKS = 3, 24, 2
#: Sketches of word pairs: FEW_WORDS over the words of a text, FEW_SKETCHES at most. Long texts would meet by chance in them and need none.
FEW_K, FEW_SKETCHES, FEW_WORDS = 2, 16, 1024
_M = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word):
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, text: str) -> np.ndarray:
        """The hashes of a text's words. Bytes are split at the very white space that ends a word."""
        w = text.encode("utf-8", "surrogatepass").split()
        return np.fromiter(map(self.__getitem__, w), "u8", len(w))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


@lru_cache
def _seeds(n: int) -> np.ndarray:
    return _mixed(np.arange(1, n + 1, dtype="u8") * _M)


def _smallest(h: np.ndarray, top: int) -> np.ndarray:
    """Where the ``top`` smallest entries of each row are; h is used up."""
    out, rows = np.empty((len(h), top), "i8"), np.arange(len(h))
    for j in range(top):
        out[:, j] = h.argmin(axis=1)
        h[rows, out[:, j]] = np.uint64(0xFFFFFFFFFFFFFFFF)
    return out


def order_minhash(words: np.ndarray, k: int = K, sketches: int = SKETCHES, picks: int = PICKS) -> np.ndarray:
    """One 64-bit value for each hash order; words: 64-bit hashes in text order."""
    n = max(1, len(words) - k + 1)
    g = np.zeros(n, "u8")
    for j in range(min(k, len(words))):
        g *= _M
        g += words[j : j + n] if len(words) >= k else words[j : j + 1]
    g = _mixed(g + occurrences(g) * _M)
    seeds = _seeds(sketches)
    top = min(picks, n)
    out = seeds.copy()
    step = max(1, 2_000_000 // n)
    for lo in range(0, sketches, step):
        h = (g[None, :] ^ seeds[lo : lo + step, None]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        at = np.tile(np.arange(n), (len(h), 1)) if top == n else np.sort(_smallest(h, top), axis=1)
        for j in range(top):
            out[lo : lo + step] *= _M
            out[lo : lo + step] += g[at[:, j]]
    return _mixed(out)


def distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of two sequences if it is at most ``most``, else most + 1."""
    n = min(len(a), len(b))
    ne = np.flatnonzero(a[:n] != b[:n])
    head = int(ne[0]) if len(ne) else n
    a, b, n = a[head:], b[head:], n - head
    if n:
        ne = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
        tail = int(ne[0]) if len(ne) else n
        a, b = a[: len(a) - tail], b[: len(b) - tail]
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or len(b) - len(a) > most:
        return min(len(b), most + 1)
    return min(_banded(b.tolist(), a.tolist(), min(most, len(b))), most + 1)


def distances(pairs: list[tuple[np.ndarray, np.ndarray]], most: list[int]) -> list[int]:
    """distance() of each pair."""
    return [distance(a, b, m) for (a, b), m in zip(pairs, most, strict=True)]


def _banded(down: list[int], across: list[int], k: int) -> int:
    """Edit distance within the 2 * k + 1 diagonals around the main one, over k if it is more; down is the longer text.

    A band's column is kept as the differences of cells one below the other, a bit each (Hyyrö's
    form of Myers' bit vectors), in whole numbers of the band's width.
    """
    if not k:
        return int(down != across)
    width = 2 * k + 1
    full, low = (1 << width) - 1, len(down) - k
    at: dict[int, int] = {}
    for i, w in enumerate(down):
        at[w] = at.get(w, 0) | 1 << (i + k)
    up, less = ((1 << (k + 1)) - 1) << k, 0  # where cells grow and shrink downwards
    found, last, edge = k, 1 << (width - 1), 1 << (width - 2)
    hopeless = 2 * k + len(across) - len(down)
    for i, w in enumerate(across):
        same = at.get(w, 0) >> i & full
        level = ((((same & up) + up) & full) ^ up) | same | less  # cells equal to the one before on their diagonal
        right, left = less | full & ~(level | up), level & up  # where cells grow and shrink to the right
        if i < low:  # along the lowest diagonal, then along the last row
            found += not level & last
        else:
            found += bool(right & edge) - bool(left & edge)
            edge >>= 1
        if found > hopeless:
            return k + 1
        level >>= 1
        up, less = left | full & ~(level | right), level & right
    return found


def limit(longer: int, similarity: float) -> int:
    """The largest distance that is similar enough."""
    return int((1 - similarity) * longer + 1e-9)


def occurrences(words: np.ndarray) -> np.ndarray:
    """How often each entry occurred before."""
    s = np.sort(words)
    if not (s[1:] == s[:-1]).any():
        return np.zeros(len(words), "u8")
    order = np.argsort(words, kind="stable")
    s = words[order]
    at = np.arange(len(s))
    out = np.empty(len(s), "u8")
    out[order] = at - np.maximum.accumulate(np.where(np.concatenate(([True], s[1:] != s[:-1])), at, 0)) if len(s) else at
    return out


def parities(words: np.ndarray, longs: int = PARITY) -> np.ndarray:
    """A map of 64 * longs bits, each the parity of how many words, labelled with their occurrence, hash to it."""
    tokens = _mixed(words + occurrences(words) * _M)
    odd = np.bincount((tokens % np.uint64(64 * longs)).astype("i8"), minlength=64 * longs) & 1
    return np.packbits(odd.astype("u1"), bitorder="little").view("i8")


def wide_maps(texts: DataFrame) -> DataFrame:
    """(h, wide) of (h, text): parity maps that grow with the text, eight bits or more a word, their longs a power of two."""

    def run(batches):
        memo = _Hashes()
        for pdf in batches:
            maps = []
            for text in pdf["text"]:
                w = memo.of(text)
                longs = 1 << (max(PARITY, -(-len(w) // 8)) - 1).bit_length()
                maps.append(parities(w, longs))
            yield pd.DataFrame({"h": pdf["h"], "wide": maps})

    return texts.select("h", "text").mapInPandas(run, "h binary, wide array<long>")


def sketches_of(codes: np.ndarray, k: int = K, sketches: int = SKETCHES, picks: int = PICKS) -> np.ndarray:
    """All sketches of a text, those of every text first; codes: 64-bit hashes of its words."""
    if not len(codes):
        return np.zeros(0, "u8")
    own = [order_minhash(codes, k, sketches, picks), order_minhash(codes, MORE_K, MORE_SKETCHES, MORE_PICKS)]
    if few := min(FEW_SKETCHES, FEW_WORDS // len(codes)):
        own.append(order_minhash(codes, FEW_K, few, picks))
    return np.concatenate(own)


def sketched(nodes: DataFrame, k: int = K, sketches: int = SKETCHES, picks: int = PICKS) -> DataFrame:
    """(h, n, sketch, p) of (h, text), a row for each h; n: words; p: the parity map, a struct of longs."""

    def run(batches):
        memo, seen = _Hashes(), set()
        for pdf in batches:
            h, n, sk, odd = [], [], [], []
            for key, text in zip(pdf["h"], pdf["text"], strict=True):
                if key in seen:  # copies in one task are looked at once
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(key)
                codes = memo.of(text)
                if len(codes):
                    h.append(key)
                    n.append(len(codes))
                    odd.append(parities(codes))
                    sk.append(sketches_of(codes, k, sketches, picks).view("i8"))
            if h:
                bits = np.array(odd, "i8").reshape(len(h), PARITY)
                yield pd.DataFrame({"h": h, "n": n, "sketch": sk} | {f"p{i}": bits[:, i] for i in range(PARITY)})

    parts = [f"p{i}" for i in range(PARITY)]
    out = nodes.mapInPandas(run, "h binary, n long, sketch array<long>, " + ", ".join(f"{p} long" for p in parts))
    return out.select("h", "n", "sketch", F.struct(*parts).alias("p")).dropDuplicates(["h"])


def _tokens(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and word pairs, each labelled with its occurrence."""
    two = _mixed(words[:-1] * _M + words[1:])
    return _mixed(words + occurrences(words) * _M), _mixed(two + occurrences(two) * _M)


def _may_be(x: tuple, y: tuple, most: int) -> bool:
    """Whether texts of these tokens may be at most ``most`` edits apart: one edit takes one word and two word pairs of the longer text at most."""
    return all(len(np.intersect1d(a, b, assume_unique=True)) >= max(len(a), len(b)) - most * k for k, (a, b) in enumerate(zip(x, y, strict=True), 1))


def jump(a: np.ndarray, b: np.ndarray) -> int:
    """Edits of the best alignment that leaves the main diagonal once, for the one that ends with both texts: the distance is that at most."""
    if len(a) > len(b):
        a, b = b, a
    n, off = len(a), len(b) - len(a)
    before = np.concatenate(([0], np.cumsum(a != b[:n])))
    if not off:
        return int(before[-1])
    after = np.concatenate((np.cumsum((a != b[off:])[::-1])[::-1], [0]))
    return int((before + after).min()) + off


def aligned(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of the pairs that are similar enough."""
    left = texts.select(F.col("h").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("h").alias("b"), F.col("text").alias("y"))

    def run(batches):
        memo = _Hashes()
        for pdf in batches:
            for lo in range(0, len(pdf), 1000):
                part = pdf.iloc[lo : lo + 1000]
                known = {t: memo.of(t) for t in {*part["x"], *part["y"]}}
                both = [(known[x], known[y]) for x, y in zip(part["x"], part["y"], strict=True)]
                most = np.array([limit(max(len(x), len(y)), similarity) for x, y in both])
                # most links show in one look; of the others those are aligned that have enough in common
                ok = np.array([jump(x, y) <= m for (x, y), m in zip(both, most, strict=True)], bool)
                rest = np.flatnonzero(~ok)
                tokens = {t: _tokens(known[t]) for t in {*part["x"].iloc[rest], *part["y"].iloc[rest]}}
                rest = np.array([i for i in rest if _may_be(tokens[part["x"].iloc[i]], tokens[part["y"].iloc[i]], most[i])], "i8")
                ok[rest] = np.array(distances([both[i] for i in rest], most[rest].tolist()), "i8") <= most[rest]
                yield pd.DataFrame({"a": part["a"][ok], "b": part["b"][ok]})

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInPandas(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """(h, root) of links (a, b): one node of each component stands for all of its nodes.

    Every step maps a node to the smallest one around it, follows the map twice more, and replaces
    the links' ends by what they map to. Links inside a component so vanish, and what is left shrinks.
    """
    edges = written(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where(F.col("a") != F.col("b")).distinct(), "links")
    labels, steps = edges.select(F.col("a").alias("h")).distinct().withColumn("root", F.col("h")), 0
    while not edges.isEmpty():
        hook = written(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "hooks")
        of = lambda n: hook.select(F.col("a").alias(n), F.col("m").alias(f"{n}_"))  # noqa: B023, E731
        to = written(of("h").join(of("h_"), "h_").join(of("h__"), "h__").select("h", F.col("h___").alias("m")), "hooked")
        labels = labels.join(to.select(F.col("h").alias("root"), "m"), "root", "left").select("h", F.coalesce("m", "root").alias("root"))
        steps += 1
        one = edges.join(to.select(F.col("h").alias("a"), F.col("m").alias("x")), "a").select("b", "x")
        two = one.join(to.select(F.col("h").alias("b"), F.col("m").alias("y")), "b")
        less = written(two.where(F.col("x") != F.col("y")).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
        forget(hook, *[edges] * (steps > 1))
        edges = less
        if steps % 3 == 0:
            labels = written(labels, "labels")
    return labels if steps % 3 == 0 else written(labels, "labels")


def _named(df: DataFrame, to: str, **more: str) -> DataFrame:
    """h, n and the parity map of bucket members under names of their own."""
    return df.select("i", "v", F.col("h").alias(to), F.col("n").alias(f"n{to}"), F.col("p").alias(f"p{to}"), *[F.col(v).alias(k) for k, v in more.items()])


def _most(similarity: float):
    """The largest distance of a pair (a, b) that is similar enough."""
    return F.floor(F.lit(1 - similarity) * F.greatest("na", "nb") + 1e-6)


def _odd_most(similarity: float):
    """The most tokens that only one of a pair (a, b) has: ``most`` at most of the longer text, so as many less the difference of lengths of the shorter."""
    return 2 * _most(similarity) - F.abs(F.col("na") - F.col("nb"))


def _possible(similarity: float):
    """What every pair (a, b) that is similar enough fulfils: like lengths, and few odd differences."""
    odd = sum((F.bit_count(F.col(f"pa.p{i}").bitwiseXOR(F.col(f"pb.p{i}"))) for i in range(PARITY)), F.lit(0))
    return (F.least("na", "nb") >= F.lit(similarity - 1e-9) * F.greatest("na", "nb")) & (odd <= _odd_most(similarity))


def _likely(similarity: float):
    """The same by the wide maps xa and xb. Lengths that are alike differ by one doubling of the map at most; the longer map is folded then."""
    half = lambda c: F.zip_with(F.slice(c, 1, (F.size(c) / 2).cast("int")), F.slice(c, (F.size(c) / 2).cast("int") + 1, (F.size(c) / 2).cast("int")), lambda x, y: x.bitwiseXOR(y))
    odd = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda s, u: s + u)
    a, b = F.col("xa"), F.col("xb")
    return F.when(F.size(a) == F.size(b), odd(a, b)).when(F.size(a) > F.size(b), odd(half(a), b)).otherwise(odd(a, half(b))) <= _odd_most(similarity)


def components_of(keyed: DataFrame, copies: DataFrame, *, k: int = K, sketches: int = SKETCHES, picks: int = PICKS, similarity: float = SIMILARITY) -> DataFrame:
    """(h, root) of the texts that have links. keyed: (k, h, text), a row for each document; copies: (h, k), the document of each text that stands for it."""
    spark = keyed.sparkSession
    with small_batches(spark):
        sketch = written(sketched(keyed.select("h", "text"), k, sketches, picks), "sketches")
    dealt = sketch.select("h", F.posexplode("sketch").alias("i", "v"))
    shared = dealt.groupBy("i", "v").agg(F.count("*").alias("c")).where(F.col("c") > 1)
    # a text that shares much with many is the better leader, and the same one in most buckets of a group
    weight = F.sum("c").over(Window.partitionBy("h"))
    bucket = written(dealt.join(shared, ["i", "v"]).join(sketch.select("h", "n", "p"), "h").select("h", "i", "v", "n", "p", weight.alias("w")), "buckets")
    sweep(keyed.sparkSession)
    member = copies.join(bucket.select("h").distinct(), "h", "left_semi").select("h", "k")
    # by h and k, so that copies of one text are in no one task
    texts = written(keyed.join(member, ["h", "k"], "left_semi").groupBy("h", "k").agg(F.any_value("text").alias("text")).select("h", "text"), "bucket-texts")
    sweep(keyed.sparkSession)
    possible = _possible(similarity)

    row = F.struct((-F.col("w")).alias("w"), "h", "n", "p")
    lead = bucket.groupBy("i", "v").agg(F.min(row).alias("l"))
    first = _named(lead.select("i", "v", "l.*"), "a").join(_named(bucket, "b"), ["i", "v"]).where((F.col("a") != F.col("b")) & possible)
    with small_batches(spark):
        star = written(aligned(first.select("a", "b").distinct(), texts, similarity), "star-links")
    sweep(keyed.sparkSession)
    roots = components(star)

    member = bucket.join(roots, "h", "left").withColumn("root", F.coalesce("root", "h"))
    leader = lead.select("i", "v", F.col("l.h").alias("h")).join(roots, "h", "left").select("i", "v", F.coalesce("root", "h").alias("main"))
    mixed = written(member.join(leader, ["i", "v"]).where(F.col("root") != F.col("main")).select("i", "v", "main").distinct(), "mixed-buckets")
    crowd = written(member.join(mixed, ["i", "v"]), "mixed-members")
    with small_batches(spark):
        maps = written(wide_maps(texts.join(crowd.select("h").distinct(), "h", "left_semi")), "wide-maps")
    crowd = crowd.join(maps.join(sketch.select("h", "sketch"), "h"), "h")
    main, other = crowd.where(F.col("root") == F.col("main")), crowd.where(F.col("root") != F.col("main"))
    # a pair meets in every bucket it shares, all of them mixed; the first one emits it
    earlier = lambda c: F.slice(c, 1, F.col("i"))
    once = F.forall(F.zip_with(earlier("sa"), earlier("sb"), lambda x, y: x != y), lambda x: x)
    passes = possible & once & _likely(similarity)
    across = _named(main, "a", xa="wide", sa="sketch").join(_named(other, "b", xb="wide", sb="sketch"), ["i", "v"]).where(passes).select("a", "b")
    one, two = _named(other, "a", ra="root", xa="wide", sa="sketch"), _named(other, "b", rb="root", xb="wide", sb="sketch")
    among = one.join(two, ["i", "v"]).where((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & passes).select("a", "b")
    with small_batches(spark):
        late = written(aligned(across.union(among), texts, similarity), "late-links")
    sweep(keyed.sparkSession)
    if not late.isEmpty():
        roots = components(star.unionByName(late))
    forget(sketch, bucket, texts, star, mixed, crowd, maps, late)
    return roots


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """A row for each row of docs: id, h (digest of the text), class_id (smallest id of the class), class_size (rows), keep (the id and text that stay)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    keyed = docs.select(F.col(f"`{id_col}`").alias("id"), F.unhex(F.md5(text)).alias("h"), text.alias("text"))
    slim = written(keyed.select("id", "h"), "ids")
    named = F.struct(F.col("id").isNull().alias("none"), "id")
    copies = slim.groupBy("h").agg(F.min(named).alias("least"), F.count("*").alias("n"))
    copies = written(copies.select("h", F.col("least.id").alias("least"), F.xxhash64("least.id").alias("k"), "n"), "copies")
    roots = components_of(keyed.select(F.xxhash64("id").alias("k"), "h", "text"), copies, **how)
    of = copies.join(roots, "h", "left").select("h", F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("id")).alias("least"), "n", F.coalesce("root", "h").alias("root"))
    total = of.groupBy("root").agg(F.min(F.struct("least", "h")).alias("m"), F.sum("n").alias("class_size"))
    of = of.join(total, "root").select("h", F.col("m.least.id").alias("class_id"), F.col("m.h").alias("kh"), "class_size")
    keep = (F.col("h") == F.col("kh")) & F.col("id").eqNullSafe(F.col("class_id"))
    return slim.join(of, "h").select(F.col("id").alias(id_col), "h", "class_id", "class_size", keep.alias("keep"))


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one row of each class: the one with the smallest id."""
    kept = classes(docs, id_col=id_col, text_col=text_col, **how).where("keep").select(F.col("h").alias("__h"), F.col(id_col).alias("__i")).distinct()
    h = F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    joined = docs.withColumn("__k", h).join(kept, (F.col("__k") == F.col("__h")) & F.col(f"`{id_col}`").eqNullSafe(F.col("__i")), "left_semi")
    return joined.dropDuplicates(["__k"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_minhash_near_dedup(spark, sf_dir):
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "keep")
