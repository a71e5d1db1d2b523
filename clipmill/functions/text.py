"""Text rules of the label contract, as Column functions (no Python in the tasks)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipmill.constants import INVALID

LINE_BREAK = r"[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
NOT_LINE_BREAK = r"[^\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


# White space at the ends of a text: tabs, line breaks and Unicode's spaces (fixed value), and the separators U+001C to U+001F.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
SEPARATORS = "\x1c\x1d\x1e\x1f"


def strip(c: Column) -> Column:
    """Without white space at both ends, in one pass from each end."""
    return F.btrim(c, F.lit(SPACES + SEPARATORS))


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _keep(c: Column, allowed: str) -> Column:
    kept = F.regexp_replace(F.lower(_text(c)), f"[^{allowed}]+", "")
    return F.trim(F.regexp_replace(kept, " +", " "))


def normalize_gloss(c: Column) -> Column:
    """Lower case, drop all but ``a-z0-9_ -``, single spaces."""
    return _keep(c, "a-z0-9_ \\-")


def normalize_gloss_keep_apostrophe(c: Column) -> Column:
    return _keep(c, "a-z0-9_ '\\-")


def normalize_word(c: Column) -> Column:
    """Lower case, letters, digits and apostrophe only."""
    return F.regexp_replace(F.lower(_text(c)), "[^a-z0-9']+", "")


def canonicalize_text(c: Column) -> Column:
    """Lower case and whitespace folding only."""
    return F.trim(F.regexp_replace(F.lower(_text(c)), r"(?U)\s+", " "))


def in_labels(c: Column, labels: Sequence[str]) -> Column:
    return F.coalesce(c.isin(list(labels)), F.lit(False))


def output_label(raw: Column) -> Column:
    """The first piece between ``\\n , ; :`` that has any kept character, normalised; null without one.

    One leftmost regular-expression match finds that piece, so the row stays in generated code.
    """
    piece = F.regexp_extract(F.lower(_text(raw)), r"([^\n,;:]*[a-z0-9_\-][^\n,;:]*)", 1)
    return F.nullif(normalize_gloss(piece), F.lit(""))


def resolve_output_split(df: DataFrame, raw: str, labels: Sequence[str]) -> DataFrame:
    """Add ``label`` (see ``output_label``) and ``valid``: is it in the contract."""
    return df.withColumn("label", output_label(F.col(raw))).withColumn("valid", in_labels(F.col("label"), labels))


def resolve_output_first_line(raw: Column, labels: Sequence[str]) -> Column:
    """struct(status, prediction) from the first line, even an empty one."""
    label = normalize_gloss(F.regexp_extract(_text(raw), f"^({NOT_LINE_BREAK}*)", 1))
    ok = in_labels(label, labels)
    return F.struct(
        F.when(ok, "ok").otherwise("uncertain").alias("status"), F.when(ok, label).alias("prediction")
    )


def first_full_line(raw: Column) -> Column:
    """First line with a visible character, from that character on."""
    return F.regexp_extract(_text(raw), rf"(?U)(\S{NOT_LINE_BREAK}*)", 1)


# Wrapper characters removed from both ends (fixed value).
_WRAP = " .,:;!?\"'`()[]{}"


def _unwrap(c: Column) -> Column:
    return F.btrim(c, F.lit(_WRAP))


def _mentions(labels: Sequence[str]):
    """Arrow-batched function: how many distinct labels a text mentions with no letter beside them (2 for more), and the first of them.

    One automaton over all labels reads a text once, however many labels there are. It is built once in each Python worker.
    """
    names = tuple(dict.fromkeys(x for x in labels if x))

    @F.pandas_udf("hits int, label string")
    def find(texts: pd.Series) -> pd.DataFrame:
        automaton = _automaton(names)
        hits, found = [], []
        for text in texts:
            seen: list[str] = []
            for end, label in automaton.iter(text) if text and names else ():
                start = end - len(label)
                if not (start >= 0 and "a" <= text[start] <= "z" or end + 1 < len(text) and "a" <= text[end + 1] <= "z") and label not in seen:
                    seen.append(label)
                    if len(seen) == 2:
                        break
            hits.append(len(seen))
            found.append(seen[0] if seen else None)
        return pd.DataFrame({"hits": pd.array(hits, "Int32"), "label": pd.array(found, "string")})

    return find


@lru_cache(maxsize=8)
def _automaton(names: tuple[str, ...]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for x in names:
        made.add_word(x, x)
    made.make_automaton()
    return made


def _json_text(parsed: Column, path: str) -> Column:
    """Text at ``path`` if the value there is a JSON string."""
    value = F.try_variant_get(parsed, path, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(parsed, path, "string"))


def resolve_output_reason(df: DataFrame, raw: str, labels: Sequence[str]) -> DataFrame:
    """Add label and reason: an exact or wrapped label, else the only label mentioned.

    Works in stages, each a column computed once. Mentions are looked for only in rows without an exact label.
    """
    parsed, names = F.col("_v"), list(labels)
    wanted = ("$.translation", "$.label", "$.gloss", "$.answer", "$")
    exact, hits = F.col("_exact"), F.col("_m.hits")
    trimmed = lambda c: F.btrim(c, F.lit(SPACES))
    return (
        df.withColumn("_t", trimmed(_text(F.col(raw))))
        .withColumn("_v", F.try_parse_json("_t"))
        .withColumn(
            "_c",
            F.filter(
                F.array(F.col("_t"), trimmed(F.substring_index("_t", "\n", 1)), *[_json_text(parsed, p) for p in wanted]),
                lambda c: trimmed(c) != "",
            ),
        )
        .withColumn("_c", F.transform("_c", lambda c: canonicalize_text(_unwrap(c))))
        .withColumn("_exact", F.get(F.filter("_c", lambda c: c.isin(names)), F.lit(0)))
        .withColumn("_m", _mentions(names)(F.when(exact.isNull(), F.array_join("_c", " || "))))
        .withColumn("label", F.when(exact.isNotNull(), exact).when(hits == 1, F.col("_m.label")).otherwise(INVALID))
        .withColumn(
            "reason",
            F.when(exact.isNotNull(), "exact_or_wrapper").when(hits == 1, "single_mention").when(hits > 1, "ambiguous").otherwise("no_match"),
        )
        .drop("_t", "_v", "_c", "_exact", "_m")
    )


def _line(key: str) -> str:
    return rf"(?:^|{LINE_BREAK})(?:{key})={NOT_LINE_BREAK}*"


def line_value(text: Column, key: str) -> Column:
    """Trimmed value of the first ``key=`` line, null without such a line; the search ends at that line."""
    line = F.regexp_extract(_text(text), _line(key), 0)
    return F.when(line != "", strip(F.regexp_replace(line, rf"^{LINE_BREAK}?{key}=", "")))


def sample_key(text: Column) -> Column:
    """``sample_id=`` value (may be blank), else the first 12 hex digits of sha256."""
    return F.coalesce(line_value(text, "sample_id"), F.left(F.sha2(_text(text), 256), F.lit(12)))


_SHAPE = r"^(\d+)\s+features_per_frame=(\d+)$"


def parse_input_block(df: DataFrame, text: str) -> DataFrame:
    """Add struct ``p`` of the ``key=value`` lines; ``shape_ok`` is null when there is no shape line.

    One search gathers the lines of all keys; each value is then taken from the first line of its key.
    """
    values = ("sample_id", "encoding", "pose_q64", "pose")
    lines = F.transform(
        F.regexp_extract_all(_text(F.col(text)), F.lit(f"({_line('|'.join((*values, 'frames')))})"), F.lit(1)),
        lambda x: F.regexp_replace(x, f"^{LINE_BREAK}", ""))
    first = lambda key: F.get(F.filter("_lines", lambda x: F.startswith(x, F.lit(f"{key}="))), F.lit(0))
    value = lambda key: strip(F.substr(first(key), F.lit(len(key) + 2)))
    number = lambda i: F.regexp_extract("_shape", _SHAPE, i).try_cast("bigint")
    return (
        df.withColumn("_lines", lines).withColumn("_shape", value("frames"))
        .withColumn("p", F.struct(
            *[value(k).alias(k) for k in values], F.col("_shape").rlike(_SHAPE).alias("shape_ok"), number(1).alias("frames"), number(2).alias("features")))
        .drop("_lines", "_shape")
    )


def parse_pose_text(pose: Column) -> Column:
    """``v,v;v,v`` -> array of frames of doubles; blank frames and values are skipped."""
    frames = F.filter(F.transform(F.split(pose, ";"), lambda f: strip(f)), lambda f: f != "")
    return F.transform(
        frames,
        lambda f: F.transform(F.filter(F.split(f, ","), lambda v: v != ""), lambda v: v.cast("double")),
    )


def _label_lines(labels: Sequence[str]) -> str:
    return "\n".join(f"- {x}" for x in labels)


def record_prompt(instruction: Column, text: Column) -> Column:
    return strip(F.concat(strip(_text(instruction)), F.lit("\n\n"), strip(_text(text))))


# Prompt wording (fixed values).
_PROMPT_LIST = (
    "Classify this compact ASL pose encoding into one WLASL gloss.\n"
    "You must choose exactly one label from the canonical Top-50 label list below.\n"
    "Reply with only the chosen label. Do not include punctuation, "
    "explanation, formatting, or any label outside this list.\n\n"
    "Canonical Top-50 labels:\n"
)
_PROMPT_FIRST = (
    "You are evaluating an ASL pose/frame-derived sample.\n"
    "Return exactly one canonical gloss from the allowlist below.\n"
    "Output must be only the gloss token (no explanation/punctuation).\n\n"
    "Allowlist:\n"
)
_PROMPT_RETRY = (
    "STRICT RETRY (deterministic): your previous output was out-of-vocabulary.\n"
    "Choose EXACTLY one token from this allowlist and output only that token.\n"
    "Allowlist tokens: "
)
_PROMPT_FRAMES = (
    "Identify the ASL sign shown across these frames. "
    "Return exactly one gloss label from the approved list.\n"
    "Approved labels: "
)
PROMPT_OUTPUT_CONTRACT = (
    "Return exactly one label from the approved list. "
    "Output only the label text in lowercase, with no extra words, punctuation, or JSON."
)


def label_list_prompt(text: Column, labels: Sequence[str]) -> Column:
    return strip(F.concat(F.lit(_PROMPT_LIST + _label_lines(labels) + "\n\n"), strip(_text(text))))


def first_pass_prompt(text: Column, labels: Sequence[str]) -> Column:
    return F.concat(F.lit(_PROMPT_FIRST + _label_lines(labels) + "\n\nSample:\n"), strip(_text(text)))


def retry_prompt(text: Column, labels: Sequence[str], previous: Column) -> Column:
    return F.concat(
        F.lit(_PROMPT_RETRY + ", ".join(labels) + "\nPrevious output: "),
        python_quoted(previous),
        F.lit("\nSample: "),
        strip(_text(text)),
    )


def frames_prompt(labels: Sequence[str]) -> Column:
    return F.lit(_PROMPT_FRAMES + ", ".join(labels))


def python_quoted(c: Column) -> Column:
    """Text in quotes with backslash, line break and tab escaped; double quotes only when needed."""
    s = _text(c)
    for plain, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        s = F.replace(s, F.lit(plain), F.lit(shown))
    single, double = F.contains(s, F.lit("'")), F.contains(s, F.lit('"'))
    return (
        F.when(single & ~double, F.concat(F.lit('"'), s, F.lit('"')))
        .when(single, F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("\\'")), F.lit("'")))
        .otherwise(F.concat(F.lit("'"), s, F.lit("'")))
    )


def display_translation(c: Column) -> Column:
    """First letter upper case plus a full stop; blank gives null."""
    n = normalize_gloss(c)
    return F.when(n != "", F.concat(F.upper(F.substring(n, 1, 1)), F.substr(n, F.lit(2)), F.lit(".")))


def redact_filename(c: Column) -> Column:
    """``file_`` + 10 hex digits of sha256 + lower-case extension (``.bin`` without one)."""
    name = _text(c)
    ext = F.lower(F.regexp_extract(name, r"[^/.][^/]*?(\.[^./]*)$", 1))
    return F.concat(F.lit("file_"), F.left(F.sha2(name, 256), F.lit(10)), F.when(ext == "", ".bin").otherwise(ext))


def bool_strict(c: Column) -> Column:
    """true/false only; anything else is null (a violation)."""
    s = F.lower(strip(_text(c)))
    return F.when(s == "true", True).when(s == "false", False)


def bool_lenient(c: Column) -> Column:
    return F.lower(strip(_text(c))).isin("1", "true", "yes")


def bool_provider(value: Column) -> Column:
    """Rule for a JSON value (VARIANT): booleans, numbers, and 1/true/yes/y."""
    kind = F.schema_of_variant(value)
    text = F.lower(strip(F.try_variant_get(value, "$", "string")))
    number = F.try_variant_get(value, "$", "double")
    return F.coalesce(
        F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        .when(kind == "STRING", text.isin("1", "true", "yes", "y"))
        .when(number.isNotNull(), number != 0),
        F.lit(False),
    )
