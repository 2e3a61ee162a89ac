"""Scalar rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slugify(name: Column) -> Column:
    return F.btrim(F.regexp_replace(F.btrim(F.lower(F.regexp_replace(name, "([A-Z])", "_$1")), F.lit("_")), "[^a-z0-9]+", "_"), F.lit("_"))


def normalise_domain(name: Column) -> Column:
    return F.substring(F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-")), 1, 40)


def safe_name(name: Column, most: int = 80) -> Column:
    return F.substring(F.regexp_replace(name, r"[^A-Za-z0-9_\-.]", "_"), 1, most)


def to_pascal(receiver: Column) -> Column:
    """self, cls, this: empty; a name that begins in upper case stays; else parts between underscores are capitalised."""
    parts = F.transform(F.split(receiver, "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 10_000))))
    return F.when(receiver.isin("self", "cls", "this"), "").when(receiver.rlike("^[A-Z]"), receiver).otherwise(F.array_join(parts, ""))


def flow_name(api: Column) -> Column:
    base = F.regexp_replace(api, "(?i)(_handler|_view|_endpoint|_api|_controller)$", "")
    words = F.filter(F.split(base, r"[_\-\s]+"), lambda w: w != "")
    return F.concat(F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 10_000)))), ""), F.lit("Flow"))


def simplify_signature(parameters: Column) -> Column:
    """Parameter names alone, without self and cls."""
    names = F.transform(F.split(parameters, ","), lambda p: F.trim(F.regexp_extract(p, r"^\s*([*\w]*)", 1)))
    return F.array_join(F.filter(names, lambda n: ~n.isin("self", "cls", "")), ", ")


def is_camel_case(name: Column) -> Column:
    return name.rlike("^[A-Z][a-zA-Z0-9]+$")


def clamp(confidence: Column) -> Column:
    return F.round(F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0)), 4)


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def parent_path(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"(\.[^.]+)$", 1))


def depth(path: Column) -> Column:
    return F.when(path == "", 0).otherwise(F.size(F.split(path, "/")))


def line_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def json_object(text: Column) -> Column:
    """The JSON object in a noisy answer: the whole text, what a fence holds, or what the first brace and its own closing one hold."""
    own, fenced = _balanced(text), _balanced(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1))
    valid = lambda t: F.when(F.try_parse_json(t).isNotNull(), t)
    return F.coalesce(F.when(own == F.trim(text), valid(own)), valid(fenced), valid(own))


def _balanced(text: Column) -> Column:
    """From the first brace to the one that closes it; braces in quoted text don't count. Empty without such a pair."""
    at = F.locate("{", text)
    rest = F.substring(text, at, F.length(text))
    # quoted text gives way to as many other characters, so that places stay
    bare = F.array_join(F.transform(F.regexp_extract_all(rest, F.lit(r'(?s)("(?:[^"\\\\]|\\\\.)*"|[^"]+|")'), 1), lambda x: F.when(x.startswith('"'), F.repeat(F.lit("_"), F.length(x))).otherwise(x)), "")
    closers = F.regexp_extract_all(bare, F.lit(r"([^{}]*[{}])"), 1)
    state = F.struct(F.lit(0).alias("open"), F.lit(0).alias("at"), F.lit(0).alias("end"))
    step = lambda s, x: F.struct(
        (s["open"] + F.when(x.endswith("{"), 1).otherwise(-1)).alias("open"),
        (s["at"] + F.length(x)).alias("at"),
        F.when((s["end"] == 0) & (s["open"] == 1) & x.endswith("}"), s["at"] + F.length(x)).otherwise(s["end"]).alias("end"),
    )
    end = F.aggregate(closers, state, step, lambda s: s["end"])
    return F.when(at > 0, F.substring(rest, F.lit(1), end)).otherwise("")


def repo_id(name: Column) -> Column:
    """A repository's name as an id: lower case, other characters than letters, digits and - become -."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9-]", "-")


def confidence(best_distance: Column) -> Column:
    return F.coalesce(F.round(F.greatest(F.lit(0.0), 1 - best_distance / 2), 2), F.lit(0.0))
