"""Prompt and reply texts as Column expressions."""

from __future__ import annotations

import html
import string

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words left out of a short prompt (fixed values).
SHORT_STOP_WORDS = ("how", "many", "count", "find", "the", "a", "an", "in", "on")

# Words that name no object (fixed values).
GENERIC_WORDS = (
    "image", "how", "what", "where", "when", "why", "which", "who",
    "many", "much", "count", "find", "show", "detect", "identify",
    "are", "is", "the", "a", "an", "in", "on", "at", "to", "for",
    "of", "with", "from", "by", "this", "that", "these", "those",
)

# Where a question names its object (fixed patterns).
OBJECT_PATTERNS = (
    r"(?:how many|count|find|detect|identify|show|locate)\s+(?:the\s+)?([a-z]+(?:\s+[a-z]+){0,2})",
    r"(?:what|which)\s+([a-z]+(?:\s+[a-z]+){0,2})",
    r"([a-z]+(?:\s+[a-z]+){0,2})\s+(?:in|on|at|from)",
)

# Nouns whose leading word describes the object, and words to vary a prompt (fixed values).
NOUN_PATTERNS = (r"(\w+)\s+tanks?", r"(\w+)\s+buildings?", r"(\w+)\s+planes?", r"(\w+)\s+cars?")
DESCRIPTORS = ("large", "small", "circular", "rectangular")

# Tools a reply may call (fixed values).
TOOL_NAMES = ("segment_phrase_batch", "examine_each_mask", "select_masks_and_return", "report_no_mask", "filter_masks_by_attributes")

# White space beyond ASCII, as a character class both Java and RE2 read (fixed value).
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def words(text: Column) -> Column:
    """Text split at white space, without empty pieces."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def _first_three(ws: Column, otherwise: Column) -> Column:
    return F.when(F.size(ws) > 0, F.array_join(F.slice(ws, 1, 3), " ")).otherwise(otherwise)


def fallback_prompt(text: Column) -> Column:
    """First three words that are no stop words, else "object"."""
    return _first_three(F.filter(words(F.lower(text)), lambda w: ~w.isin(*SHORT_STOP_WORDS)), F.lit("object"))


def fallback_prompt_rich(text: Column) -> Column:
    """The object a question names, else its first longer words, else "object"."""
    low = F.lower(text)
    specific = lambda ws: F.filter(ws, lambda w: ~w.isin(*GENERIC_WORDS))
    rest = F.filter(specific(words(low)), lambda w: F.length(w) > 2)
    tries = [F.nullif(F.array_join(F.slice(specific(words(F.regexp_extract(low, p, 1))), 1, 3), " "), F.lit("")) for p in OBJECT_PATTERNS]
    return F.coalesce(*tries, _first_three(rest, F.lit("object")))


def rephrase_fallback(previous: Column, query: Column, attempt: Column, used: Column) -> Column:
    """Another prompt to try, by attempt number, never the same one again."""
    ws = words(previous)
    many = F.size(ws) > 1
    last, first = F.element_at(ws, -1), ws[0]
    noun = F.coalesce(*[F.nullif(F.regexp_extract(F.lower(query), p, 1), F.lit("")) for p in NOUN_PATTERNS], F.concat(previous, F.lit("s")))
    described = F.array(*[F.concat(F.lit(d + " "), previous) for d in DESCRIPTORS])
    fresh = F.filter(described, lambda d: ~F.array_contains(used, d))
    described = F.when(F.size(fresh) > 0, fresh[0]).otherwise(previous)
    pick = (F.when(attempt == 0, F.when(many, last).otherwise(noun))
            .when(attempt == 1, F.when(many, first).otherwise(described))
            .otherwise(F.when(many, F.array_join(F.slice(ws, 2, F.size(ws)), " ")).otherwise(previous)))
    same = (F.lower(pick) == F.lower(previous)) | F.array_contains(used, pick)
    return F.when(same, F.when(many, F.when(last != previous, last).otherwise(first)).otherwise(F.concat(previous, F.lit("s")))).otherwise(pick)


def object_type(text: Column) -> Column:
    """Last word of the prompt without trailing "s"."""
    low = F.lower(text)
    ws = words(low)
    return F.when(F.size(ws) > 0, F.regexp_replace(F.element_at(ws, -1), "s+$", "")).otherwise(F.lit(""))


def parse_scales(text: Column) -> Column:
    """Comma list to numbers; what is no number is dropped."""
    return F.array_compact(F.transform(F.split(text, ","), lambda s: F.trim(s).try_cast("double")))


# Fixed pattern: a rated mask.
_CONFIDENCE = r"(?i)(?:Mask\s*)?(\d+)\s*[:\-]\s*(HIGH|MEDIUM|LOW)"


def confidence_lines(replies: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Rated mask numbers of each reply; a later line replaces an earlier one."""
    lines = replies.select(*keys, F.posexplode(F.split(text, "\n")).alias("_i", "_line"))
    hit = lines.select(*keys, "_i", F.regexp_extract("_line", _CONFIDENCE, 1).try_cast("bigint").alias("mask_no"),
                       F.upper(F.regexp_extract("_line", _CONFIDENCE, 2)).alias("confidence")).where(F.col("mask_no").isNotNull())
    return hit.groupBy(*keys, "mask_no").agg(F.max_by("confidence", "_i").alias("confidence"))


def verdict(text: Column) -> Column:
    """Accept or Reject from the last verdict tag; NULL for anything else."""
    tail = F.element_at(F.split(text, "<verdict>"), -1)
    v = F.split(tail, "</verdict>")[0]
    yes, no = v.contains("Accept"), v.contains("Reject")
    return F.when(yes & ~no, "Accept").when(no & ~yes, "Reject")


# Fixed patterns: calls, prompt and id lists, and arguments of replies.
_JSON_CALL = r'\{[^{}]*"name"\s*:\s*"([^"]+)"[^{}]*"arguments"\s*:\s*(\{[^{}]*\})[^{}]*\}'
_PROMPT_LISTS = (r'"text_prompts"\s*:\s*(\[[^\]]+\])', r"'text_prompts'\s*:\s*(\[[^\]]+\])", r"text_prompts\s*=\s*(\[[^\]]+\])")
_ONE_PROMPT = (r'"text_prompt"\s*:\s*"([^"]+)"', r"'text_prompt'\s*:\s*'([^']+)'", r'text_prompt\s*=\s*"([^"]+)"', r"text_prompt\s*=\s*'([^']+)'")
_ID_LISTS = (r'"final_answer_masks"\s*:\s*\[([^\]]+)\]', r"select_masks_and_return[^\[]*\[([^\]]+)\]")
_QUOTED = r"""\"[^\"]+\"|'[^']+'"""
_KEYWORD_ARG = r"""(\w+)\s*=\s*("[^"]*"|'[^']*'|\[[^\]]*\]|\{[^}]*\}|[^,\s\]]+)"""


def _calls(names: Column, arguments: Column) -> Column:
    z = F.zip_with(names, arguments, lambda n, a: F.struct(n.alias("name"), a.alias("arguments")))
    return F.filter(z, lambda c: c["name"].isin(*TOOL_NAMES))


def _one_call(name: str, arguments: Column) -> Column:
    return F.when(arguments.isNotNull(), F.array(F.struct(F.lit(name).alias("name"), arguments.alias("arguments"))))


def _json_text(v: Column) -> Column:
    """A string as JSON."""
    inner = F.to_json(F.array(v))
    return F.substring(inner, F.lit(2), F.length(inner) - 2)


def _quoted_list(v: Column) -> Column:
    """A list as JSON: kept when it is JSON, else the quoted strings in it."""
    strings = F.transform(F.regexp_extract_all(v, F.lit(_QUOTED), F.lit(0)), lambda q: _json_text(F.substring(q, F.lit(2), F.length(q) - 2)))
    return F.coalesce(F.when(F.try_parse_json(v).isNotNull(), v), F.concat(F.lit("["), F.array_join(strings, ", "), F.lit("]")))


def _json_value(v: Column) -> Column:
    """A keyword value as JSON: what its quotes hold when that is JSON (a number, say), else a string."""
    bare = F.regexp_replace(v, r"""(?s)^(["'])(.*)\1$""", "$2")
    return F.when(bare.startswith("["), _quoted_list(bare)).otherwise(F.coalesce(F.when(F.try_parse_json(bare).isNotNull(), bare), _json_text(bare)))


def extract_tool_calls(text: Column) -> Column:
    """Tool calls of a reply: the first of several notations that yields any.

    Result: array of (name, arguments as JSON text), NULL when there is none.
    """
    some = lambda a: F.when(F.size(a) > 0, a)
    named = _calls(F.regexp_extract_all(text, F.lit(_JSON_CALL), F.lit(1)), F.regexp_extract_all(text, F.lit(_JSON_CALL), F.lit(2)))

    def called(name):
        args = F.regexp_extract_all(text, F.lit(name + r"\s*\(([^)]*(?:\[[^\]]*\][^)]*)*)\)"), F.lit(1))

        def build(a):
            pairs = F.zip_with(F.regexp_extract_all(a, F.lit(_KEYWORD_ARG), F.lit(1)), F.regexp_extract_all(a, F.lit(_KEYWORD_ARG), F.lit(2)),
                               lambda k, v: F.concat(F.lit('"'), k, F.lit('": '), _json_value(v)))
            return F.struct(F.lit(name).alias("name"), F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}")).alias("arguments"))

        return F.transform(args, build)

    def followed(name):
        args = F.filter(F.regexp_extract_all(text, F.lit(name + r"\s*(\{[^{}]*\})"), F.lit(1)), lambda a: F.try_parse_json(a).isNotNull())
        return F.transform(args, lambda a: F.struct(F.lit(name).alias("name"), a.alias("arguments")))

    found = lambda patterns: F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])
    has = text.contains
    listed = found(_PROMPT_LISTS)
    batch = F.when(has("segment_phrase_batch"), F.concat(F.lit('{"text_prompts": '), _quoted_list(listed), F.lit("}")))
    single = F.when(has("segment_phrase") & ~has("segment_phrase_batch"), F.concat(F.lit('{"text_prompts": ['), _json_text(found(_ONE_PROMPT)), F.lit("]}")))
    ids = F.coalesce(*[F.when(F.try_parse_json(F.concat(F.lit("["), m, F.lit("]"))).isNotNull(), m)
                       for m in (F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in _ID_LISTS)])
    chosen = F.when(has("select_masks_and_return"), F.concat(F.lit('{"final_answer_masks": ['), ids, F.lit("]}")))
    bare = [F.when(has(n), F.array(F.struct(F.lit(n).alias("name"), F.lit("{}").alias("arguments")))) for n in ("examine_each_mask", "report_no_mask")]
    return F.coalesce(
        some(named), some(F.concat(*[called(n) for n in TOOL_NAMES])), some(F.concat(*[followed(n) for n in TOOL_NAMES])),
        _one_call("segment_phrase_batch", batch), _one_call("segment_phrase_batch", single), *bare,
        _one_call("select_masks_and_return", chosen))


# JSON objects in a reply: with one nested level, around a keywords field, flat (fixed patterns).
JSON_PATTERNS = (r"(?s)\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", r'(?s)\{.*?"keywords".*?\}', r"(?s)\{[^}]*\}")


def extract_keywords(reply: Column, query: Column) -> Column:
    """One to four keywords of a JSON reply with a primary object, else the query."""
    clean = F.regexp_replace(F.regexp_replace(reply, r"```json\s*", ""), r"```\s*", "")
    doc = F.coalesce(*[F.try_parse_json(F.nullif(F.regexp_extract(clean, p, 0), F.lit(""))) for p in JSON_PATTERNS])
    kind = lambda path: F.schema_of_variant(F.try_variant_get(doc, path, "variant"))
    ws = F.try_variant_get(doc, "$.keywords", "array<string>")
    reason = F.try_variant_get(doc, "$.reasoning", "variant")
    ok = ((kind("$.keywords") == "ARRAY<STRING>") & F.size(ws).between(1, 4) & (kind("$.primary_object") == "STRING")
          & (reason.isNull() | F.schema_of_variant(reason).isin("STRING", "VOID")))
    kept = F.filter(ws, lambda w: F.length(F.trim(w)) > 0)
    return F.when(F.coalesce(ok, F.lit(False)) & (F.size(kept) > 0), kept).otherwise(F.array(query))


def validate_reply(text: Column) -> Column:
    """A JSON reply with a boolean ``is_valid`` and a confidence in [0, 1]."""
    doc = F.try_parse_json(text)
    flag = F.schema_of_variant(F.try_variant_get(doc, "$.is_valid", "variant")) == "BOOLEAN"
    number = F.schema_of_variant(F.try_variant_get(doc, "$.confidence", "variant"))
    level = F.try_variant_get(doc, "$.confidence", "double")
    return F.coalesce(flag & number.rlike("^(BIGINT|DOUBLE|DECIMAL)") & level.between(0.0, 1.0), F.lit(False))


@F.pandas_udf(StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else html.unescape(html.unescape(v)))


# a character no text holds, standing for the kept string
_HELD = "\uffff"


def canonicalize_text(text: Column, mode: str = "canonicalize", keep: str | None = None) -> Column:
    """Unescape entities twice and collapse white space; ``lower`` also lowers,
    ``canonicalize`` also turns "_" into a space and drops ASCII punctuation,
    except the exact string ``keep``."""
    # only texts with an "&" leave the JVM
    marked = F.when(text.contains("&"), text)
    out = F.coalesce(_unescape(marked), text)
    if mode == "canonicalize":
        out = F.translate(out, "_", " ")
        if keep:
            out = F.replace(out, F.lit(keep), F.lit(_HELD))
        out = F.translate(out, string.punctuation, "")
        if keep:
            out = F.replace(out, F.lit(_HELD), F.lit(keep))
    elif mode not in ("lower", "whitespace"):
        raise ValueError(f"unknown mode {mode}")
    if mode != "whitespace":
        out = F.lower(out)
    return F.trim(F.regexp_replace(out, SPACE + "+", " "))


# ---- message logs ------------------------------------------------------------------------

def count_images(messages: DataFrame, key: str = "conv_id", parts: str = "parts") -> DataFrame:
    """Image parts per conversation; ``parts`` is an array of (type, ...) structs."""
    return messages.groupBy(key).agg(F.sum(F.size(F.filter(parts, lambda p: p["type"] == "image"))).alias("images"))


def prune_context(messages: DataFrame, called: Column, key: str = "conv_id", turn: str = "turn", role: str = "role") -> DataFrame:
    """The first two messages, and everything from the latest assistant message
    that calls the tool. The cut is one aggregate per conversation."""
    at = messages.where((F.col(role) == "assistant") & (F.col(turn) >= 2) & called).groupBy(key).agg(F.max(turn).alias("_cut"))
    j = messages.join(at, key, "left")
    return j.where((F.col(turn) < 2) | (F.col(turn) >= F.col("_cut"))).drop("_cut")
