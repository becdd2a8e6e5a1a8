"""Claims, answers, steps and confidence read from completions, as native columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .compat import MARK, let, matches, number

# What counts as a claim, as a contrast and as a connective. A pattern first looks at one letter, so most places of a text are passed over.
NUMERIC = r"(?U)(?=[\d-])(?<![\d-])-?\d+\.?\d*\s*(?:%|percent|kcal(?:/mol)?)?"
POSITION = (
    r"(?iuU)(?=[rpsdt\d])(?:\b(?:residues?|positions?|spans?|domains?|regions?|turns?)\s+(?:at\s+|of\s+)?\d{1,4}\s*(?:-|to|–)\s*\d{1,4}\b"
    r"|\b(?:residue|position)\s+\d{1,4}(?!\.\d)\b"
    r"|\b\d{1,4}\s*-\s*\d{1,4}\b(?=[\s,.;)]|$))"
)
MOTIF_TERMS = [
    "poly-alanine", "polyalanine", "poly-ala", "gpgxx", "gpgqq", "gggx", "ggx", "beta-sheet", "β-sheet", "beta-turn",
    "β-turn", "alpha-helix", "α-helix", "random coil", "spidroin repeat", "block copolymer", "amorphous region",
    "crystalline region", "intrinsically disordered", "proline-rich turn", "proline rich", "glycine-rich spacer",
    "glycine rich",
]
CONTRAST_CUES = [
    "disrupt", "unlike", "rather than", "in contrast", "as opposed to", "instead of", "without", "lacks", "lacking",
    "fails to", "contrary to", "differs from", "not consistent with", "does not", "doesn't",
]
CONNECTIVES = [
    "because", "therefore", "thus", "since", "as a result", "this suggests", "which means", "consequently", "given that",
    "this indicates", "due to", "so that", "leading to",
]
CONFIDENCE = r"(?iuU)confiden\w*\s*(?:of|:|is)?\s*(\d{1,3})\s*%|(low|moderate|high|very high|very low)\s+confidence"
QUALITATIVE = {"very low": 0.1, "low": 0.3, "moderate": 0.5, "high": 0.75, "very high": 0.9}
BEFORE, AFTER = 60, 25  # how far around a claim a contrast counts

CLAIMS = "array<struct<kind:string,raw:string,num:double,lo:int,hi:int,term:string,start:int,end:int,role:string>>"
_BLANK = "\u0002"


def _any(terms: list[str]) -> str:
    """The first term that stands at a place; those that begin alike stand together."""
    by: dict[str, list[str]] = {}
    for t in terms:
        by.setdefault(t[0], []).append(re.escape(t[1:]))
    return f"(?iu)(?=[{re.escape(''.join(by))}])(?:" + "|".join(f"{re.escape(first)}(?:{'|'.join(rest)})" for first, rest in by.items()) + ")"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def mask_list_markers(text: Column) -> Column:
    """Numbers of list items at the start of a line become spaces; lengths stay."""
    plain = F.when(text.contains(MARK) | text.contains(_BLANK), F.translate(text, MARK + _BLANK, "")).otherwise(text)
    two = F.regexp_replace(plain, r"(?mdU)^(\s*)\d{2}\.(\s)", f"$1{_BLANK * 3}$2")
    one = F.regexp_replace(two, r"(?mdU)^(\s*)\d\.(\s)", f"$1{_BLANK * 2}$2")
    return let(one, lambda t: F.when(t.contains(_BLANK), F.translate(t, _BLANK, " ")).otherwise(t))


def claims(text: Column) -> Column:
    """Numeric, then position, then motif claims, each in order of the text."""
    null = F.lit(None)

    def claim(masked: Column, m: Column, kind: str, num: Column, lo: Column, hi: Column, term: Column) -> Column:
        start = F.greatest(m["start"] - BEFORE, F.lit(0))
        near = F.substring(masked, start + 1, m["end"] + AFTER - start)
        role = F.when(near.rlike(_any(CONTRAST_CUES)), "contrastive").otherwise("direct")
        return F.struct(
            F.lit(kind).alias("kind"), strip(m["text"]).alias("raw") if kind == "numeric" else m["text"].alias("raw"), num.cast("double").alias("num"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"),
            term.cast("string").alias("term"), m["start"].alias("start"), m["end"].alias("end"), role.alias("role"),
        )

    def of(masked: Column) -> Column:
        value = lambda m: F.regexp_extract(m["text"], r"(?U)^-?\d+\.?\d*", 0)
        bare = lambda m: ~m["text"].rlike("(%|percent|kcal(/mol)?)$") & ~value(m).contains(".") & (F.length(value(m)) <= 2)
        numeric = F.transform(F.filter(matches(masked, NUMERIC), lambda m: ~bare(m)), lambda m: claim(masked, m, "numeric", number(value(m)), null, null, null))
        ends = lambda m: F.regexp_extract_all(m["text"], F.lit(r"(?U)\d+"), F.lit(0))
        position = F.transform(matches(masked, POSITION), lambda m: claim(masked, m, "position", null, ends(m)[0], F.element_at(ends(m), -1), null))
        motif = F.transform(matches(masked, _any(MOTIF_TERMS)), lambda m: claim(masked, m, "motif", null, null, null, F.lower(m["text"])))
        return F.concat(numeric, position, motif)

    return let(mask_list_markers(text), of)


def tagged(text: Column, tag: str) -> Column:
    """What stands between the first pair of tags; null without one."""
    pattern = f"(?s)<{tag}>(.*?)</{tag}>"
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


def answer(text: Column) -> Column:
    """Property to value from the first answer's JSON object; null if there is none, or if a text in it is not a number."""
    body = strip(tagged(text, "answer"))
    fields = F.try_variant_get(F.try_parse_json(F.when(body.rlike(r"(?s)^\{.*\}$"), body)), "$", "map<string,variant>")

    def read(m: Column) -> Column:
        kinds = F.transform_values(m, lambda _, v: F.struct(F.schema_of_variant(v).alias("kind"), v.alias("v")))
        plain = F.map_filter(kinds, lambda _, x: ~x["kind"].rlike("^(VOID|OBJECT|ARRAY)"))
        value = lambda x: F.when(x["kind"] == "STRING", number(F.try_variant_get(x["v"], "$", "string"))).when(x["kind"] == "BOOLEAN", F.try_variant_get(x["v"], "$", "boolean").cast("int").cast("double")).otherwise(F.try_variant_get(x["v"], "$", "double"))
        values = F.transform_values(plain, lambda _, x: value(x))
        return F.when(~F.exists(F.map_values(values), lambda v: v.isNull()), values)

    return let(fields, read)


def steps(reasoning: Column) -> Column:
    """Sentences; a blank line ends one too."""
    joined = F.regexp_replace(F.regexp_replace(strip(F.translate(reasoning, MARK, "")), r"(?U)\n\s*\n", MARK), r"(?U)\s+", " ")
    parts = F.split(F.translate(joined, MARK, "\n"), r"(?<=[.!?])\s+|\n+", -1)
    return F.filter(F.transform(parts, strip), lambda p: F.length(p) > 0)


def shares_content_word(a: Column, b: Column, shortest: int = 5) -> Column:
    words = lambda t: F.transform(F.filter(F.regexp_extract_all(t, F.lit("[a-zA-Z]+"), F.lit(0)), lambda w: F.length(w) >= shortest), F.lower)
    return F.arrays_overlap(words(a), words(b))


def coherence(text: Column) -> Column:
    """Share of steps that a connective or a shared word ties to the one before; 0.5 below two steps, 0 without reasoning."""

    def of(parts: Column) -> Column:
        n = F.size(parts)
        tied = F.zip_with(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(parts, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: b.rlike(_any(CONNECTIVES)) | shares_content_word(a, b))
        return F.when(n.isNull() | (n < 0), 0.0).when(n < 2, 0.5).otherwise(F.size(F.filter(tied, lambda t: t)) / (n - 1))

    return let(steps(tagged(text, "reasoning")), of)


def confidence(text: Column) -> Column:
    """The first confidence that a text expresses, from 0 to 1; else null."""
    percent, word = F.regexp_extract(text, CONFIDENCE, 1), F.lower(F.regexp_extract(text, CONFIDENCE, 2))
    lookup = F.create_map(*[F.lit(x) for pair in QUALITATIVE.items() for x in pair])
    return F.when(percent != "", F.least(F.lit(1.0), percent.cast("double") / 100)).when(word != "", F.try_element_at(lookup, word))
