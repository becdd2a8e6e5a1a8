"""Claims checked against the outputs of the tools that a trace called before them.

``tools`` is a trace's array of tool outputs in order of calls: name, numbers (leaves in order, no booleans), ranges, text
(all leaves, normalised) and keys (normalised). A claim and its trace's tools are one row, so nothing is shuffled before
the reports are added up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequence
from ..functions.compat import let
from ..functions.text import MOTIF_TERMS, claims

TOLERANCE, RELATIVE = 0.02, 0.03
WORST = 10

# Fields that speak for a term which no tool names outright.
HINTS = {
    "beta-sheet": ["beta_propensity", "beta_rich", "beta_threshold", "beta_sheet"],
    "β-sheet": ["beta_propensity", "beta_rich", "beta_threshold", "beta_sheet"],
    "alpha-helix": ["alpha_propensity", "helix_propensity"],
    "α-helix": ["alpha_propensity", "helix_propensity"],
    "beta-turn": ["turn_propensity", "beta_turn"],
    "β-turn": ["turn_propensity", "beta_turn"],
    "intrinsically disordered": ["predicted_disordered", "disorder"],
    "crystalline region": ["poly_alanine", "poly_ala", "beta_propensity", "beta_rich"],
    "amorphous region": ["glycine_rich_spacer", "ggx_repeat", "gpgxx_repeat"],
}


def normalise(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"(?U)[-_\s]+", "")


#: The fields of each tool's struct, in order, and what they hold.
FIELDS = {
    "motif_detector": [("motifs", "list"), ("spans", "motif_spans"), ("sequence_length", "number")],
    "hydropathy_profile": [("mean_hydropathy", "number"), ("window_size", "number"), ("most_hydrophobic_span", "span"), ("most_hydrophilic_span", "span"), ("max_window_value", "number"), ("min_window_value", "number")],
    "charge_profile": [("positive_residues", "number"), ("negative_residues", "number"), ("net_charge", "number"), ("mean_net_charge_per_residue", "number")],
    "beta_sheet_propensity": [("mean_alpha_propensity", "number"), ("mean_beta_propensity", "number"), ("mean_turn_propensity", "number"), ("beta_rich_spans", "spans"), ("beta_threshold", "number")],
    "repeat_pattern_analyzer": [("dominant_period", "number"), ("repeat_score", "number"), ("example_repeat_unit", "text")],
    "disorder_prediction_chplot": [("mean_charge", "number"), ("mean_hydropathy_normalized", "number"), ("boundary_value", "number"), ("predicted_disordered", "flag")],
}


def tool_outputs() -> Column:
    """The six tools' structs of ``sequence.with_tools`` as ``tools``."""
    span = lambda c: F.transform(F.filter(F.array(c), lambda s: s.isNotNull()), lambda s: s)
    ends = lambda spans: F.flatten(F.transform(spans, lambda s: F.array(s["lo"].cast("double"), s["hi"].cast("double"))))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(" ", s["lo"], s["hi"])), " ")

    def tool(name: str, leaves: list[tuple[str, str]]) -> Column:
        numbers, ranges, texts, keys = [], [], [], []
        for key, kind in leaves:
            c = F.col(name)[key]
            keys.append(F.array(F.lit(key)))
            if kind == "number":
                numbers.append(F.filter(F.array(c.cast("double")), lambda x: x.isNotNull()))
                texts.append(F.coalesce(c.cast("string"), F.lit("None")))
            elif kind in ("span", "spans"):
                list_ = span(c) if kind == "span" else c
                numbers.append(ends(list_))
                ranges.append(list_)
                texts.append(F.when(F.size(list_) > 0, said(list_)).otherwise("None" if kind == "span" else ""))
            elif kind == "motif_spans":
                flat = F.flatten(F.map_values(c))
                numbers.append(ends(flat))
                ranges.append(flat)
                keys.append(F.map_keys(c))
                texts.append(said(flat))
            elif kind == "list":
                texts.append(F.concat_ws(" ", c))
            elif kind == "flag":
                texts.append(F.when(c, "True").otherwise("False"))
            else:
                texts.append(F.coalesce(c, F.lit("None")))
        return F.struct(
            F.lit(name).alias("name"), F.concat(F.array().cast("array<double>"), *numbers).alias("numbers"), F.concat(F.array().cast(sequence.SPANS), *ranges).alias("ranges"),
            normalise(F.concat_ws(" ", *texts)).alias("text"), F.transform(F.concat(*keys), normalise).alias("keys"),
        )

    return F.array(*[tool(name, leaves) for name, leaves in FIELDS.items()])


def output_json(name: str) -> Column:
    """A tool's struct as JSON: its fields in order, nulls included, spans as lists of two numbers."""
    pair = lambda s: F.when(s.isNotNull(), F.array(s["lo"], s["hi"]))
    kinds = {"span": pair, "spans": lambda c: F.transform(c, pair), "motif_spans": lambda c: F.transform_values(c, lambda _, v: F.transform(v, pair))}
    return F.to_json(F.struct(*[kinds.get(kind, lambda c: c)(F.col(name)[key]).alias(key) for key, kind in FIELDS[name]]), {"ignoreNullFields": "false"})


_ITEM = "struct<kind:string,t:string,v:variant,num:double,lo:int,hi:int>"
_NUMBER = "^(BIGINT|INT|DECIMAL|DOUBLE|FLOAT)"


def _item(kind: str, **fields: Column) -> Column:
    types = {"t": "string", "v": "variant", "num": "double", "lo": "int", "hi": "int"}
    return F.struct(F.lit(kind).alias("kind"), *[fields.get(f, F.lit(None)).cast(t).alias(f) for f, t in types.items()])


def _opened(x: Column) -> Column:
    """What stands for a value: an object's keys and values in order, a list's values (behind a range, where it is two numbers), or a leaf."""
    fields, entries = F.try_variant_get(x["v"], "$", "map<string,variant>"), F.map_entries(F.from_json(x["t"], "map<string,string>"))
    listed, texts = F.try_variant_get(x["v"], "$", "array<variant>"), F.from_json(x["t"], "array<string>")
    kind = F.schema_of_variant(x["v"])
    of_object = F.flatten(F.transform(entries, lambda e: F.array(_item("key", t=e["key"]), _item("value", t=e["value"], v=F.try_element_at(fields, e["key"])))))
    of_list = F.zip_with(texts, listed, lambda t, v: _item("value", t=t, v=v))
    whole = lambda v: F.coalesce(F.try_variant_get(v, "$", "double"), F.try_variant_get(v, "$", "boolean").cast("double")).try_cast("int")
    two = (F.size(listed) == 2) & F.forall(listed, lambda v: F.schema_of_variant(v).rlike(_NUMBER + "|^BOOLEAN"))
    range_ = F.when(two, F.array(_item("range", lo=whole(listed[0]), hi=whole(listed[1])))).otherwise(F.array().cast(f"array<{_ITEM}>"))
    text = F.when(kind == "STRING", F.try_variant_get(x["v"], "$", "string")).when(kind == "BOOLEAN", F.initcap(F.try_variant_get(x["v"], "$", "string"))).when(kind == "VOID", "None").otherwise(x["t"])
    leaf = F.array(_item("leaf", t=text, num=F.when(kind.rlike(_NUMBER), F.try_variant_get(x["v"], "$", "double"))))
    return F.when(x["kind"] != "value", F.array(x)).when(fields.isNotNull(), of_object).when(listed.isNotNull(), F.concat(range_, of_list)).otherwise(leaf)


def facts(name: Column, output: Column, depth: int = 8) -> Column:
    """A tool's output, any JSON, as an entry of ``tools``.

    Values are opened level by level, each in its place, so leaves stay in order: keys as the text has them, depth first. Numbers, booleans and null as leaves read as
    in the text, "True" or "False", and "None"; any list of just two numbers is a range. What is no JSON has no leaves; deeper nesting than ``depth`` raises.
    """
    parsed = F.try_parse_json(output)
    items = F.when(parsed.isNotNull(), F.array(_item("value", t=output, v=parsed))).otherwise(F.array().cast(f"array<{_ITEM}>"))
    for _ in range(depth):
        items = F.flatten(F.transform(items, _opened))

    def of(found: Column) -> Column:
        only = lambda kind: F.filter(found, lambda x: x["kind"] == kind)
        deep = F.when(F.exists(found, lambda x: x["kind"] == "value"), F.raise_error(F.lit(f"a tool's output is nested deeper than {depth}")))
        numbers = F.filter(F.transform(only("leaf"), lambda x: x["num"]), lambda v: v.isNotNull())
        ranges = F.filter(F.transform(only("range"), lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"))), lambda r: r["lo"].isNotNull() & r["hi"].isNotNull())
        text = normalise(F.array_join(F.transform(only("leaf"), lambda x: x["t"]), " "))
        return F.struct(F.coalesce(deep.cast("string"), name).alias("name"), numbers.alias("numbers"), ranges.alias("ranges"), text.alias("text"), F.transform(only("key"), lambda x: normalise(x["t"])).alias("keys"))

    return let(items, of)


def _closest(numbers: Column, value: Column, tolerance: float) -> Column:
    """The nearest number within tolerance (of the tool's value), the first of equals; else null. NaN bears out nothing."""
    near = F.filter(numbers, lambda v: (F.abs(v - value) <= F.greatest(F.lit(tolerance), F.abs(v) * RELATIVE)) & ~F.isnan(v))
    return F.array_min(F.transform(near, lambda v, i: F.struct(F.abs(v - value).alias("diff"), i.alias("i"), v.alias("v"))))


def _in_range(ranges: Column, lo: Column, hi: Column) -> Column:
    inside = lambda r, x: x.between(F.least(r["lo"], r["hi"]), F.greatest(r["lo"], r["hi"]))
    return F.exists(ranges, lambda r: inside(r, lo) & inside(r, hi))


def _named(tool: Column, term: Column) -> Column:
    lookup = F.create_map(*[x for k, v in HINTS.items() for x in (F.lit(k), F.array(*[F.lit(h) for h in v]))])
    hints = F.coalesce(F.try_element_at(lookup, term), F.array().cast("array<string>"))
    hint = lambda h: tool["text"].contains(normalise(h)) | F.exists(tool["keys"], lambda k: k.contains(normalise(h)))
    return tool["text"].contains(normalise(term)) | F.exists(hints, hint)


def ground(claimed: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Adds grounded, evidence_tool, matched and diff; the latest tool that has evidence counts.

    claimed: a row for each claim, with kind, num, lo, hi, term and ``tools``.
    """
    c, latest = F.col, F.reverse("tools")
    none = F.lit(None).cast("struct<diff:double,i:int,v:double>")
    # Each kind looks at its own lists, once a tool.
    rated = F.filter(F.transform(latest, lambda t: F.struct(t["name"].alias("name"), _closest(t["numbers"], c("num"), tolerance).alias("best"))), lambda x: x["best"].isNotNull())
    named = lambda held: F.transform(F.filter(latest, held), lambda t: F.struct(t["name"].alias("name"), none.alias("best")))
    hits = F.when(c("kind") == "numeric", rated).when(c("kind") == "position", named(lambda t: _in_range(t["ranges"], c("lo"), c("hi")))).when(c("kind") == "motif", named(lambda t: _named(t, c("term"))))
    first = F.get(hits, F.lit(0))
    with_first = claimed.withColumn("__e", first)
    return with_first.select(*claimed.columns, c("__e").isNotNull().alias("grounded"), c("__e")["name"].alias("evidence_tool"), c("__e")["best"]["v"].alias("matched"), c("__e")["best"]["diff"].alias("diff"))


def _axis(x: Column, tolerance: float) -> Column:
    """A scale on which a number and a claim that it bears out lie within 1.05 of each other: even as far as the tolerance is, logarithmic beyond."""
    turn = tolerance / RELATIVE
    far = F.when(F.abs(x) <= turn, F.abs(x) / tolerance).otherwise(1 / RELATIVE + F.log(F.abs(x) / turn) / RELATIVE)
    return F.when(x < 0, -far).otherwise(far)


def ground_asof(claimed: DataFrame, tools: DataFrame, key: str, tolerance: float = TOLERANCE) -> DataFrame:
    """As ``ground``, with tools as rows: the latest tool call before a claim's step that has evidence counts.

    claimed: key, step_index and a claim; tools: key, step_index and ``tool``. Each distinct claim of a trace meets the numbers in bins near its own, the distinct
    ranges, and the tools that name its term; what bears it out becomes a list by step, in which each place of the claim looks up the last entry before it.
    """
    c = F.col
    which = ["kind", "num", "lo", "hi", "term"]
    wanted = claimed.where("kind is not null").select(c(key).alias("k"), *which).distinct()
    own = tools.select(c(key).alias("k"), c("step_index").alias("step"), "tool")
    width = 1.1
    bin_ = lambda x: F.floor(_axis(x, tolerance) / width)
    asked = wanted.where("kind = 'numeric'").select("k", "num", F.explode(F.array(*[bin_(c("num")) + by for by in (-1, 0, 1)])).alias("bin"))
    leaves = own.select("k", "step", c("tool.name").alias("name"), F.posexplode("tool.numbers").alias("i", "v")).where("not isnan(v)").withColumn("bin", bin_(c("v")))
    near = leaves.join(asked, ["k", "bin"]).withColumn("diff", F.abs(c("v") - c("num"))).where(c("diff") <= F.greatest(F.lit(tolerance), F.abs("v") * RELATIVE))
    null = lambda name, kind: F.lit(None).cast(kind).alias(name)
    best = near.groupBy("k", "num", "step").agg(F.min(F.struct("diff", "i", "v", "name")).alias("b"))
    found = best.select("k", F.lit("numeric").alias("kind"), "num", null("lo", "int"), null("hi", "int"), null("term", "string"), F.struct("step", c("b.name").alias("name"), c("b.v").alias("v"), c("b.diff").alias("diff")).alias("e"))
    bare = F.struct("step", "name", null("v", "double"), null("diff", "double")).alias("e")
    ranges = own.select("k", "step", c("tool.name").alias("name"), F.explode("tool.ranges").alias("r")).groupBy("k", F.least("r.lo", "r.hi").alias("from"), F.greatest("r.lo", "r.hi").alias("to")).agg(F.collect_set(F.struct("step", "name")).alias("calls"))
    inside = ranges.join(wanted.where("kind = 'position'"), "k").where("lo between `from` and `to` and hi between `from` and `to`")
    held = inside.select("k", "lo", "hi", F.explode("calls").alias("call")).distinct().select("k", "lo", "hi", "call.*")
    found = found.unionByName(held.select("k", F.lit("position").alias("kind"), null("num", "double"), "lo", "hi", null("term", "string"), bare))
    terms = F.filter(F.array(*[F.lit(t) for t in MOTIF_TERMS]), lambda t: _named(c("tool"), t))
    named = own.select("k", "step", c("tool.name").alias("name"), F.explode(terms).alias("term")).join(wanted.where("kind = 'motif'").select("k", "term"), ["k", "term"])
    found = found.unionByName(named.select("k", F.lit("motif").alias("kind"), null("num", "double"), null("lo", "int"), null("hi", "int"), "term", bare))
    lists = found.groupBy("k", *which).agg(F.array_sort(F.collect_list("e")).alias("calls")).select(c("k").alias("__k"), *[c(w).alias(f"__{w}") for w in which], "calls")
    same = [c(a).eqNullSafe(c(b)) for a, b in ((key, "__k"), *((w, f"__{w}") for w in which))]
    met = claimed.join(lists, same, "left")
    last = F.element_at(F.filter("calls", lambda e: e["step"] < c("step_index")), -1)
    with_last = met.withColumn("__e", F.when(F.exists("calls", lambda e: e["step"] < c("step_index")), last))
    return with_last.select(*claimed.columns, c("__e").isNotNull().alias("grounded"), c("__e")["name"].alias("evidence_tool"), c("__e")["v"].alias("matched"), c("__e")["diff"].alias("diff"))


def explode_claims(traces: DataFrame, text: str) -> DataFrame:
    """A row for each claim, with ``claim_ord``; a trace without claims keeps one row of nulls."""
    fields = ["kind", "raw", "num", "lo", "hi", "term", "start", "end", "role"]
    found = traces.select("*", F.posexplode_outer(claims(F.col(text))).alias("claim_ord", "claim"))
    return found.select(*traces.columns, "claim_ord", *[F.col("claim")[f].alias(f) for f in fields])


def report(grounded: DataFrame, *keys: str) -> DataFrame:
    """A row for each trace: counts of direct and contrastive claims, and their grounded shares."""
    direct, contrast, hit = F.col("role") == "direct", F.col("role") == "contrastive", F.col("grounded")
    counts = grounded.groupBy(*keys).agg(
        F.count_if(direct).alias("n_direct"), F.count_if(direct & hit).alias("n_direct_grounded"), F.count_if(contrast).alias("n_contrastive"), F.count_if(contrast & hit).alias("n_contrastive_grounded")
    )
    return counts.withColumn("grounding_score", F.coalesce(F.try_divide("n_direct_grounded", "n_direct"), F.lit(1.0))).withColumn("contrastive_score", F.try_divide("n_contrastive_grounded", "n_contrastive"))


def audit(reports: DataFrame) -> DataFrame:
    """One row about all traces."""
    return reports.agg(
        F.count("*").alias("n_traces"),
        F.coalesce(F.avg("grounding_score"), F.lit(1.0)).alias("mean_grounding_score"),
        F.coalesce(F.avg((F.col("grounding_score") == 1.0).cast("double")), F.lit(1.0)).alias("fully_grounded_fraction"),
        F.coalesce(F.sum("n_contrastive"), F.lit(0)).alias("n_contrastive_mentions"),
        F.try_divide(F.sum(F.col("n_contrastive") - F.col("n_contrastive_grounded")), F.sum("n_contrastive")).alias("contrastive_ungrounded_fraction"),
    )


def audit_by_kind(grounded: DataFrame) -> DataFrame:
    """Direct claims and how many of them are ungrounded, by kind."""
    return grounded.where("role = 'direct'").groupBy("kind").agg(F.count("*").alias("n_claims"), F.count_if(~F.col("grounded")).alias("n_ungrounded"))


def worst_traces(reports: DataFrame, key: str, n: int = WORST) -> DataFrame:
    """The traces of lowest score, in order; ties by key."""
    return reports.orderBy("grounding_score", key).limit(n)
