"""Text, JSON and identifier expressions for profile-like records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys that hold the same attribute in different sources, in order of preference.
NAME_KEYS = ("name", "title", "display_name", "username", "slug")
DESCRIPTION_KEYS = ("description", "bio", "biography", "about")
ID_KEYS = ("pid", "id", "profileId", "profile_id")
TYPE_KEYS = {"mbti": ("mbti", "mbti_type", "type_mbti"), "socionics": ("socionics", "socionics_type", "type_socionics"), "big5": ("big5", "big_five")}
NESTED_TYPE_KEYS = {"mbti": ("mbti", "mbti_type"), "socionics": ("socionics", "socionics_type"), "big5": ("big5", "big_five")}

# Guardrail patterns by reason.
GUARDRAILS = {
    "direct_type_request": (
        r"(?i)\b(your|you're|you are)\s+(an?\s+)?(ILE|LII|ESE|SEI|SLE|LSI|EIE|IEI|LIE|ILI|SEE|ESI|IEE|EII|LSE|SLI)\b",
        r"(?i)\bwhat\s+type\s+am\s+i\b",
    ),
    "prohibited_topic": (r"(?i)\bdiagnos(e|is|tic)\b",),
}

# Tails of page slugs that are no part of a name.
SLUG_TAILS = ("-mbti-personality-type", "-personality-type", "-mbti", "-personality", "-enneagram", "-big-five", "-big5", "-pdb-profiles")


def json_text(json: Column, *keys: str) -> Column:
    """The first of these top-level or dotted keys whose value is neither missing nor empty."""
    return F.coalesce(*(F.nullif(F.get_json_object(json, f"$.{k}"), F.lit("")) for k in keys))


def pick_name(json: Column, keys: Sequence[str] = NAME_KEYS) -> Column:
    return json_text(json, *keys)


def int_like(value: Column) -> Column:
    """The value if it is an integer or a string of digits, else null."""
    return F.when(F.trim(value).rlike(r"^-?[0-9]{1,18}$"), F.trim(value).try_cast("long"))


def first_id(json: Column, keys: Sequence[str] = ID_KEYS) -> Column:
    return F.coalesce(*(int_like(F.get_json_object(json, f"$.{k}")) for k in keys))


def normalized_profile(json: Column) -> Column:
    """struct(name, description, mbti, socionics, big5) with synonyms, then nested attributes or, only where these are missing or
    empty, props."""
    held = F.get_json_object(json, "$.attributes")
    missing = held.isNull() | held.isin("", "{}", "[]", "false", "0", "null")

    def attribute(field: str) -> Column:
        nested = NESTED_TYPE_KEYS[field]
        other = F.when(missing, json_text(json, *(f"props.{k}" for k in nested))).otherwise(json_text(json, *(f"attributes.{k}" for k in nested)))
        return F.coalesce(json_text(json, *TYPE_KEYS[field]), other)

    return F.struct(
        F.coalesce(json_text(json, *NAME_KEYS), F.lit("")).alias("name"),
        F.coalesce(json_text(json, *DESCRIPTION_KEYS), F.lit("")).alias("description"),
        *(attribute(f).alias(f) for f in TYPE_KEYS),
    )


def without_provenance(fields: Column) -> Column:
    return F.map_filter(fields, lambda k, v: ~k.startswith("_"))


def tokens(text: Column) -> Column:
    """Lower-cased tokens between white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")


def ascii_words(text: Column) -> Column:
    """Lower-cased runs of a-z and 0-9."""
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda t: t != "")


def clean_name(name: Column) -> Column:
    """Quotes and white space stripped at both ends, inner white space collapsed."""
    return F.regexp_replace(F.regexp_replace(name, r"^['\"\s]+|['\"\s]+$", ""), r"\s+", " ")


def title_case(name: Column) -> Column:
    """Words in title case; upper-case words of up to four characters stay."""
    return F.array_join(F.transform(F.split(name, " "), lambda w: F.when((F.length(w) <= 4) & (w == F.upper(w)), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w)))))), " ")


def natural_order(name: Column) -> Column:
    """"Last, First" as "First Last"."""
    parts = F.split(name, ",")
    return F.when(name.rlike(r"^[^,]+,\s*[^,]+$"), F.concat_ws(" ", F.trim(parts[1]), F.trim(parts[0]))).otherwise(name)


def display_name(name: Column) -> Column:
    n = clean_name(natural_order(name))
    return F.when((n == F.upper(n)) | (n == F.lower(n)), title_case(n)).otherwise(n)


def aliases(name: Column) -> Column:
    """The name, what it quotes or puts in parentheses, and its parts between slashes; each once, in that order."""
    found = F.flatten(F.array(*(F.regexp_extract_all(name, F.lit(p), F.lit(1)) for p in ('"([^"]+)"', "“([^”]+)”", "‘([^’]+)’", r"\(([^)]+)\)"))))
    parts = F.when(name.contains("/"), F.split(name, "/")).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.transform(F.concat(F.array(name), found, parts), lambda a: F.trim(a)), lambda a: a != ""))


def slug_name(url: Column) -> Column:
    """A name from the last path segment that is no number, without known tails."""
    segments = F.filter(F.split(F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit("")), "/"), lambda s: s != "")
    last, before = F.try_element_at(segments, F.lit(-1)), F.try_element_at(segments, F.lit(-2))
    slug = F.lower(F.try_url_decode(F.when(last.rlike("^[0-9]+$") & before.isNotNull(), before).otherwise(last)))
    for tail in SLUG_TAILS:
        slug = F.regexp_replace(slug, f"{tail}.*$", "")
    words = F.filter(F.split(F.replace(slug, F.lit("-"), F.lit(" ")), r"\s+"), lambda w: w != "")
    return F.nullif(F.array_join(F.transform(words, lambda w: F.when(F.length(w) > 2, F.initcap(w)).otherwise(w)), " "), F.lit(""))


def guardrail_reasons(text: Column) -> Column:
    found = [F.when(F.greatest(*(text.rlike(p) for p in patterns)) if len(patterns) > 1 else text.rlike(patterns[0]), F.lit(reason)) for reason, patterns in GUARDRAILS.items()]
    return F.array_compact(F.array(*found))


def redacted(text: Column) -> Column:
    return F.when(F.size(guardrail_reasons(text)) > 0, F.lit("[REDACTED_FOR_GUARDRAIL]")).otherwise(text)


def duration_seconds(spec: Column, default: int = 3600) -> Column:
    """Seconds of "1h30m" and the like: number and unit s, m, h, d or w, added up; the default without any."""
    unit = F.create_map(*(F.lit(x) for x in ("s", 1, "m", 60, "h", 3600, "d", 86400, "w", 604800)))
    amounts = F.regexp_extract_all(spec, F.lit(r"(?i)(\d+)([smhdw])"), F.lit(1))
    units = F.regexp_extract_all(F.lower(spec), F.lit(r"(\d+)([smhdw])"), F.lit(2))
    total = F.aggregate(F.zip_with(amounts, units, lambda a, u: a.cast("long") * unit[u].cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return F.when(total > 0, total).otherwise(F.lit(default).cast("long"))


def category(value: Column, rules: Sequence[tuple[Sequence[str], str]], default: str) -> Column:
    """The label of the first rule of which a term occurs in the lower-cased value."""
    v, out = F.lower(F.coalesce(value, F.lit(""))), None
    for terms, label in rules:
        hit = F.lit(False)
        for t in terms:
            hit = hit | v.contains(t)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default) if out is not None else F.lit(default)


def vote_confidence(votes: Column) -> Column:
    """votes / 100 within 0.30 and 0.95."""
    return F.least(F.lit(0.95), F.greatest(F.lit(0.30), votes / F.lit(100.0)))


def list_items(text: Column) -> Column:
    """Items between commas and white space."""
    return F.filter(F.split(text, r"[\s,]+"), lambda x: x != "")


def context_line(created: Column, channel: Column, message: Column, author: Column, score: Column) -> Column:
    stamp = F.date_format(F.timestamp_seconds(created), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.format_string("[%s] ch:%s msg:%s author:%s score:%.3f", stamp, channel.cast("string"), message.cast("string"), F.substring(author, 1, 8), score)
