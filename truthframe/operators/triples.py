"""Triples out of ontology text: prefixes, line translation, cleaning, features, encodings, embeddings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from truthframe.functions import text as X
from truthframe.functions.bodies import body_triples
from truthframe.session import materialize

#: Heads that declare an entity's kind, and the kinds as objects of ``is`` (fixed values).
DECLARATIONS = ("Class", "ObjectProperty", "DataProperty", "AnnotationProperty", "Individual", "Datatype", "Ontology")
TRIPLE = "struct<s:string,p:string,o:string>"


def remove_prefixes(lines: DataFrame, by: str = "file_name", line: str = "line") -> DataFrame:
    """Lines without prefix declarations, and without the aliases that their file declares, brackets and ``http://``.

    Aliases go longest first, as one may end another. A file's aliases are few and joined to its lines as an array.
    """
    alias = F.regexp_extract(line, r"^\s*Prefix:\s*(.*?)\s*:\s*<.*>\s*$", 1)
    found = lines.filter(F.col(line).contains("Prefix:")).select(by, alias.alias("alias")).filter("alias != ''").distinct()
    aliases = found.groupBy(by).agg(F.reverse(F.array_sort(F.collect_list(F.struct(F.length("alias").alias("n"), "alias")))).alias("aliases"))
    rest = lines.filter(~F.col(line).contains("Prefix:")).join(aliases, by, "left")
    bare = F.aggregate(F.coalesce("aliases", F.array().cast("array<struct<n:int,alias:string>>")), F.col(line), lambda s, a: F.replace(s, F.concat(a["alias"], F.lit(":"))))
    return rest.withColumn(line, F.replace(F.replace(bare, F.lit("<http://"), F.lit("")), F.lit(">"), F.lit(""))).drop("aliases")


def translate_lines(lines: DataFrame, by: str = "file_name", order: str = "line_no", line: str = "line") -> DataFrame:
    """``(file_name, pos, s, p, o)``: Manchester lines as triples.

    A line with ``and `` continues the one before. ``Head: tail`` makes tail the subject and says that it is a Head, unless
    that is a mere declaration; ``Head:`` makes Head the relation (``Types`` is ``is``); any other line is an object.
    One pass over each file in order, by windows that carry the last subject and relation on.
    """
    w = Window.partitionBy(by).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    t = F.trim(F.regexp_replace(line, r"[\r\n]", ""))
    rows = lines.select(by, order, t.alias("t")).filter(~F.col("t").contains("Prefix:"))
    rows = rows.withColumn("part", F.sum(F.when(F.col("t").contains("and ") & (F.row_number().over(w) > 1), 0).otherwise(1)).over(upto))
    joined = rows.groupBy(by, "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "t"))), lambda x: x["t"]), " ").alias("t"))
    joined = joined.filter((F.col("t") != "") & (F.col("t") != "Ontology:"))
    w = Window.partitionBy(by).orderBy("part")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    at = F.instr("t", ":")
    joined = joined.select(
        by, "part", "t", F.when(at > 0, F.trim(F.expr("substring(t, 1, instr(t, ':') - 1)"))).alias("head"), F.when(at > 0, F.trim(F.expr("substring(t, instr(t, ':') + 1)"))).alias("tail")
    )
    names_subject = F.col("tail").isNotNull() & (F.col("tail") != "")
    # without a subject so far, a plain line is one
    first = F.count_if(names_subject | F.col("head").isNull()).over(upto) == 1
    subject = F.when(names_subject, F.col("tail")).when(F.col("head").isNull() & first, F.col("t"))
    relation = F.when(names_subject, "is").when(F.col("head").isNotNull(), F.when(F.col("head") == "Types", "is").otherwise(F.col("head")))
    out = joined.withColumns({"s": F.last(subject, True).over(upto), "p": F.coalesce(F.last(relation, True).over(upto), F.lit("is")), "starts": F.coalesce(F.col("head").isNull() & first, F.lit(False))})
    kind = names_subject & ~F.col("head").isin(*DECLARATIONS)
    plain = F.col("head").isNull() & ~F.col("starts")
    return out.filter(kind | plain).select(by, F.col("part").alias("pos"), "s", F.when(kind, "is").otherwise(F.col("p")).alias("p"), F.when(kind, F.col("head")).otherwise(F.col("t")).alias("o"))


def clean_triples(triples: DataFrame, by: str = "file_name") -> DataFrame:
    """Facts split at two blanks, disjoint classes at commas; without empty, comment and declaration triples, each once, at its first place."""
    s, p, o = F.trim("s"), F.trim("p"), F.col("o")
    cut = F.instr("o", "  ")
    fact = (p == "Facts") & (cut > 0)
    p2 = F.when(fact, F.trim(F.expr("substring(o, 1, instr(o, '  '))"))).otherwise(p)
    o2 = F.when(fact, F.trim(F.expr("substring(o, instr(o, '  ') + 2)"))).otherwise(F.trim(o))
    many = F.when(p2 == "DisjointWith", F.transform(F.split(o2, ","), lambda x: F.trim(x))).otherwise(F.array(o2))
    rows = triples.select(by, "pos", s.alias("s"), p2.alias("p"), F.posexplode(many).alias("sub", "o"))
    comment = F.lower(F.concat_ws(" ", "s", "p", "o")).contains("comment")
    keep = (F.col("s") != "") & (F.col("p") != "") & (F.col("o") != "") & ~comment & ~((F.col("p") == "is") & F.col("o").isin(*DECLARATIONS))
    return rows.filter(keep).groupBy(by, "s", "p", "o").agg(F.min(F.struct("pos", "sub")).alias("at")).select(by, F.col("at.pos").alias("pos"), "s", "p", "o")


def parse_bodies(df: DataFrame, body: str = "body") -> DataFrame:
    """``triples array<struct<s,p,o>>`` of bodies in any of the notations; null where they are null or broken."""
    return df.withColumn("triples", body_triples(body))


def injected(pattern: Column, strict: bool = True) -> Column:
    """Whether a row names an injected pattern; not ``strict`` also takes ``""`` and ``nan`` for none."""
    p = F.lower(F.trim(pattern))
    return F.coalesce(~p.isin(*(("none",) if strict else ("none", "", "nan"))), F.lit(False))


def structural_features(triples: DataFrame, by: str = "onto", length: str | None = None) -> DataFrame:
    """``(onto, feature)``: what a set of triples shows of its structure, each feature once.

    Kinds: predicates, operators and tokens of objects, counts in buckets, pairs of predicates and of operators, and
    flags of the graph. All are distinct rows or aggregates over an ontology's triples; only the 24 first predicates
    make pairs. ``subclass_cycle`` is found for all ontologies together, by taking edges away from the ends.
    """
    kept = [by, "s", "p", "o"] + ([length] if length else [])
    triples = materialize(triples.select(*kept), "triples")  # read several times
    t = triples.select(by, X.shorten(F.col("s")).alias("s"), X.shorten(F.col("p")).alias("p"), X.shorten(F.col("o")).alias("o"))
    owl = ("subclassof", "subpropertyof", "equivalentto", "disjointwith", "disjointclasses", "domain", "range", "types")
    ops = X.operators_in(F.col("o"))
    tokens = F.filter(F.slice(X.expression_tokens(F.col("o")), 1, 8), lambda x: ~F.lower(x).isin(*X.OPERATORS) & (F.length(x) <= 96))
    lower = F.lower("p")
    empty = F.array().cast("array<string>")
    per_row = F.concat(
        F.array(F.concat(F.lit("pred="), "p")),
        F.when(lower.isin(*owl), F.array(F.concat(F.lit("owl_pred="), lower))).otherwise(empty),
        F.when((lower == "subclassof") & (F.col("s") == F.col("o")), F.array(F.lit("graph:reflexive_subclass"))).otherwise(empty),
        F.when(F.col("o").rlike("[()]"), F.array(F.concat(F.lit("pred_has_paren_obj="), "p"))).otherwise(empty),
        F.when(F.col("o").contains(","), F.array(F.concat(F.lit("pred_has_comma_obj="), "p"))).otherwise(empty),
        F.flatten(F.transform(ops, lambda x: F.array(F.concat(F.lit("obj_op="), x), F.concat(F.lit("pred_op="), F.col("p"), F.lit("::"), x)))),
        F.flatten(F.transform(tokens, lambda x: F.array(F.concat(F.lit("obj_token="), x), F.concat(F.lit("pred_obj_token="), F.col("p"), F.lit("::"), x)))),
    )
    rows = t.select(by, F.explode(per_row).alias("feature")).distinct()  # what else there is comes once by itself

    counts = t.groupBy(by).agg(
        F.count("*").alias("triples"),
        F.array_sort(F.collect_set("p")).alias("preds"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(ops)))).alias("ops"),
        F.size(F.collect_set("s")).alias("subjects"),
        F.size(F.collect_set("o")).alias("objects"),
        F.size(F.array_union(F.collect_set("s"), F.collect_set("o"))).alias("entities"),
    )

    def pairs(c: Column, prefix: str) -> Column:
        return F.flatten(F.transform(c, lambda a: F.transform(F.filter(c, lambda b: b > a), lambda b: F.concat(F.lit(prefix), a, F.lit("&&"), b))))

    per_onto = F.concat(
        X.bucket_features("n_triples", F.col("triples")),
        X.bucket_features("n_subjects", F.col("subjects")),
        X.bucket_features("n_objects", F.col("objects")),
        X.bucket_features("n_entities", F.col("entities")),
        X.bucket_features("n_predicates", F.size("preds"), (1, 2, 3, 4, 5, 8, 12, 20, 40)),
        pairs(F.slice("preds", 1, 24), "pred_pair="),
        pairs(F.col("ops"), "obj_op_pair="),
    )
    rows = rows.unionByName(counts.select(by, F.explode(per_onto).alias("feature")))

    usage = t.groupBy(by, "p").agg(F.count("*").alias("n"))
    used = F.filter(F.array(*(F.when(F.col("n") >= b, F.concat(F.lit("pred_count="), "p", F.lit(f">={b}"))) for b in (1, 2, 3, 5, 10, 20, 50, 100))), lambda x: x.isNotNull())
    rows = rows.unionByName(usage.select(by, F.explode(used).alias("feature")))

    flag = lambda df, name: df.select(by).distinct().select(by, F.lit(f"graph:{name}").alias("feature"))
    subject = t.groupBy(by, "s").agg(F.countDistinct("p").alias("preds"), F.count_if(F.col("p") == "SubClassOf").alias("subs"), F.countDistinct(F.when(lower == "subclassof", F.col("o"))).alias("targets"))
    subclass, subproperty = t.filter(lower == "subclassof"), t.filter(lower == "subpropertyof")
    chained = lambda e: e.join(e.select(by, F.col("o").alias("s")), [by, "s"], "left_semi")
    flags = [
        flag(subclass, "has_subclass_edges"),
        flag(subproperty, "has_subproperty_edges"),
        flag(chained(subclass), "subclass_chain_len2"),
        flag(chained(subproperty), "subproperty_chain_len2"),
        flag(subject.filter("preds >= 2"), "same_subject_multiple_predicates"),
        flag(subject.filter("subs >= 2"), "same_subject_repeated_subclassof"),
        flag(subject.filter("targets >= 2"), "same_subject_multiple_subclass_targets"),
        flag(subclass_cycles(triples, by), "subclass_cycle"),
    ]
    for f in flags:
        rows = rows.unionByName(f)
    if length:
        n = triples.groupBy(by).agg(F.max(F.col(length).cast("int")).alias("n")).filter("n > 0")
        rows = rows.unionByName(n.select(by, F.explode(X.bucket_features("tokenized_length", F.col("n"), X.LENGTH_BUCKETS)).alias("feature")))
    return rows


def subclass_cycles(triples: DataFrame, by: str = "onto") -> DataFrame:
    """Ontologies with a directed cycle of subclass edges, found together: nodes are (ontology, name)."""
    from truthframe.operators.graphs import on_cycle

    e = triples.filter(F.lower("p") == "subclassof").select(F.struct(by, F.col("s").alias("n")).alias("src"), F.struct(by, F.col("o").alias("n")).alias("dst"))
    return on_cycle(e).select(F.col(f"src.{by}").alias(by)).distinct()


def rule_atoms(features: DataFrame, by: str = "onto") -> DataFrame:
    """``(onto, rule)``: conditions over an ontology's features that hint at an inconsistency."""
    f = F.col("feature")
    any_of = lambda c: F.bool_or(c)
    h = features.groupBy(by).agg(
        any_of((f == "owl_pred=subclassof") | f.startswith("pred=SubClassOf")).alias("sub"),
        any_of((f == "owl_pred=disjointwith") | f.contains("DisjointClasses") | f.contains("DisjointWith")).alias("dis"),
        any_of((f == "owl_pred=equivalentto") | f.contains("Equivalent")).alias("equ"),
        any_of((f == "owl_pred=subpropertyof") | f.contains("SubPropertyOf")).alias("prop"),
        any_of((f == "owl_pred=domain") | f.contains("Domain")).alias("dom"),
        any_of((f == "owl_pred=range") | f.contains("Range")).alias("ran"),
        any_of(f.isin(*(f"obj_op={x}" for x in ("not", "only", "max", "min", "exactly")))).alias("neg"),
        any_of(f == "graph:subclass_cycle").alias("cycle"),
        any_of(f.isin("graph:same_subject_multiple_subclass_targets", "graph:subclass_chain_len2")).alias("multi"),
    )
    c = lambda name: F.col(name)
    rules = {
        "rule_subclass_cycle": c("cycle"),
        "rule_disjoint_subclass_conflict": c("sub") & c("dis") & c("multi"),
        "rule_disjoint_equivalent_mix": c("equ") & c("dis"),
        "rule_property_constraint_mix": c("prop") & c("dom") & c("ran"),
        "rule_negated_restriction": c("sub") & c("neg"),
    }
    held = F.filter(F.array(*(F.when(cond, name) for name, cond in rules.items())), lambda x: x.isNotNull())
    return h.select(by, F.explode(held).alias("rule"))


def vocabulary(tokens: DataFrame, token: str = "token", least: int = 1, most: int | None = None, first_id: int = 2) -> DataFrame:
    """``(token, n, id)``: tokens by count, then name; ids from ``first_id`` (0 pads, 1 is unknown). ``most`` keeps the top."""
    counts = tokens.groupBy(token).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    if most is not None:  # the top is bounded, and cut in every task before one orders it
        top = counts.orderBy(F.col("n").desc(), token).limit(most)
        return top.withColumn("id", F.row_number().over(Window.orderBy(F.col("n").desc(), token)) + (first_id - 1))
    from truthframe.operators.fuzzy_logic import with_rank

    keyed = counts.withColumn("key", F.struct((-F.col("n")).alias("n"), F.col(token).alias("t")))
    return with_rank(keyed, "key", "id").select(token, "n", (F.col("id") + (first_id - 1)).alias("id"))


def supervised_vocabulary(features: DataFrame, labels: DataFrame, by: str, most: int, least: int = 1, group: Column | None = None) -> DataFrame:
    """``(feature, df, pos_rate, neg_rate, score)`` of the features whose rates differ most between the classes.

    ``labels`` is (by, label 0/1). Order: score, document frequency (both descending), name; with ``group`` the ``most``
    best of each group, by score and then the sum of the rates.
    """
    totals = labels.agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    seen = features.select(by, "feature").distinct().join(labels, by)
    counts = seen.groupBy("feature").agg(F.count("*").alias("df"), F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("q")).filter(F.col("df") >= least)
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    scored = counts.crossJoin(F.broadcast(totals)).select("feature", "df", rate("p", "pos").alias("pos_rate"), rate("q", "neg").alias("neg_rate"))
    scored = scored.withColumn("score", F.abs(F.col("pos_rate") - F.col("neg_rate")))
    s = F.round("score", 12).desc()
    if group is None:
        return scored.orderBy(s, F.col("df").desc(), "feature").limit(most)
    w = Window.partitionBy("group__").orderBy(s, F.round(F.col("pos_rate") + F.col("neg_rate"), 12).desc(), "feature")
    return scored.withColumn("group__", group).withColumn("nth__", F.row_number().over(w)).filter(F.col("nth__") <= most).drop("group__", "nth__")


def polarity(scored: DataFrame) -> DataFrame:
    """+1 for features more frequent among positives, -1 for the others."""
    return scored.withColumn("polarity", F.when(F.col("pos_rate") >= F.col("neg_rate"), 1).otherwise(-1))


def feature_bounds(rows: DataFrame, vocabulary_df: DataFrame, features: DataFrame, by: str = "onto") -> DataFrame:
    """``(onto, feature, l, u)`` for every row and feature of the vocabulary: (0.75, 1) where present, (0, 0) where absent."""
    every = rows.select(by).distinct().crossJoin(vocabulary_df.select("feature"))
    here = features.select(by, "feature").distinct().withColumn("here", F.lit(True))
    out = every.join(here, [by, "feature"], "left")
    return out.select(by, "feature", F.when(F.col("here"), 0.75).otherwise(0.0).alias("l"), F.when(F.col("here"), 1.0).otherwise(0.0).alias("u"))


def local_ids(triples: DataFrame, by: str = "onto", most: int | None = None, first_id: int = 2) -> DataFrame:
    """``(onto, entity, local_id)``: ids in order of first appearance within an ontology, subject before object; beyond ``most`` they are 1, unknown."""
    e = triples.select(by, F.explode(F.array(F.struct((F.col("pos") * 2).alias("at"), F.col("s").alias("entity")), F.struct((F.col("pos") * 2 + 1).alias("at"), F.col("o").alias("entity")))).alias("e"))
    first = e.groupBy(by, "e.entity").agg(F.min("e.at").alias("at"))
    nth = F.row_number().over(Window.partitionBy(by).orderBy("at"))  # within one ontology
    ids = nth + (first_id - 1)
    return first.withColumn("local_id", ids if most is None else F.when(nth <= most, ids).otherwise(1)).select(by, "entity", "local_id")


def entity_overflow(triples: DataFrame, most: int, by: str = "onto") -> DataFrame:
    """``(onto, entities, overflow, unknown_ends)``: an ontology's entities, those beyond ``most``, and the ends of triples that these stand at."""
    ids = local_ids(triples, by, most)
    ends = triples.select(by, F.explode(F.array("s", "o")).alias("entity")).join(ids.filter("local_id = 1"), [by, "entity"]).groupBy(by).agg(F.count("*").alias("unknown_ends"))
    counts = ids.groupBy(by).agg(F.count("*").alias("entities"), F.count_if(F.col("local_id") == 1).alias("overflow"))
    return counts.join(ends, by, "left").fillna(0, ["unknown_ends"])


def encode_triples(triples: DataFrame, predicates: DataFrame, by: str = "onto", most: int | None = None) -> DataFrame:
    """``(onto, pos, s_id, p_id, o_id)`` with local entity ids and a vocabulary of predicates (token, id); unknown predicates are 1.

    A predicate is looked up as ``p::op`` with the first restriction word of its object, if there is one.
    """
    ids = local_ids(triples, by, most)
    op = X.first_restriction(F.col("o"))
    t = triples.withColumn("token", F.when(op == "none", F.col("p")).otherwise(F.concat("p", F.lit("::"), op)))
    t = t.join(ids.select(by, F.col("entity").alias("s"), F.col("local_id").alias("s_id")), [by, "s"]).join(ids.select(by, F.col("entity").alias("o"), F.col("local_id").alias("o_id")), [by, "o"])
    return t.join(predicates.select("token", "id"), "token", "left").select(by, "pos", "s_id", F.coalesce("id", F.lit(1)).alias("p_id"), "o_id")


def multi_hot(encoded: DataFrame, entities: int, relations: int, by: str = "onto") -> DataFrame:
    """``(onto, s, o, p)`` of the encoded triples within the ranges: the ones of a multi-hot adjacency."""
    ok = F.col("s_id").between(0, entities - 1) & F.col("o_id").between(0, entities - 1) & F.col("p_id").between(0, relations - 1)
    return encoded.filter(ok).select(by, F.col("s_id").alias("s"), F.col("o_id").alias("o"), F.col("p_id").alias("p")).distinct()


def hash_embedding(tokens: DataFrame, by: str, dimensions: int, token: str = "token", fallback: Column | None = None, source: DataFrame | None = None) -> DataFrame:
    """``(by, index, value)``: summed hashed weights of the tokens, of length 1; sparse, zeros left out.

    Rows of ``source`` without any token get values from the sha-256 of ``fallback`` instead.
    """
    counts = tokens.groupBy(by, token).agg(F.count("*").alias("n"))  # a token is hashed once for each key that has it
    slots = counts.select(by, "n", X.hash_slot(F.col(token), dimensions).alias("h")).groupBy(by, "h.index").agg(F.sum(F.col("n") * F.col("h.weight")).alias("v"))
    if source is not None:
        rest = source.join(tokens.select(by).distinct(), by, "left_anti")
        h = F.sha2(fallback.cast("binary"), 256)
        i = F.explode(F.sequence(F.lit(0), F.lit(dimensions - 1))).alias("index")
        byte = F.conv(F.expr("substring(h, (index % 32) * 2 + 1, 2)"), 16, 10).cast("double")
        slots = slots.unionByName(rest.select(by, h.alias("h"), i).select(by, "index", (byte / 255 * 2 - 1).alias("v")))
    # a key's slots in one row, at most one for each dimension
    vectors = slots.groupBy(by).agg(F.collect_list(F.struct("index", "v")).alias("slots"))
    norm = F.sqrt(F.aggregate("slots", F.lit(0.0), lambda s, x: s + x["v"] * x["v"]))
    out = vectors.select(by, norm.alias("norm"), F.explode("slots").alias("x"))
    return out.filter("x.v != 0").select(by, "x.index", (F.col("x.v") / F.col("norm")).alias("value"))


def relative_positions(lengths: DataFrame, by: str, order: str, length: str) -> DataFrame:
    """``start`` and ``end`` of each part in a sequence of parts."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(length).over(w)
    return lengths.withColumns({"start": end - F.col(length), "end": end})


def entity_counts(elements: DataFrame, schema: DataFrame | None = None, by: str = "file") -> DataFrame:
    """``(file, classes, properties, combined)``: distinct names with and without an identifying attribute; with a schema only those it has.

    ``elements`` is (file, tag, identified boolean), ``schema`` (tag).
    """
    if schema is not None:
        elements = elements.join(schema.select("tag").distinct(), "tag", "left_semi")
    kinds = elements.groupBy(by, "tag").agg(F.bool_or("identified").alias("identified"))
    return kinds.groupBy(by).agg(F.count_if("identified").alias("classes"), F.count_if(~F.col("identified")).alias("properties"), F.count("*").alias("combined"))


def dense_histogram(df: DataFrame, value: str) -> DataFrame:
    """``(value, n)`` for every whole number from 0 to the largest."""
    counts = df.groupBy(F.col(value).cast("int").alias("value")).agg(F.count("*").alias("n"))
    bins = counts.agg(F.max("value").alias("m")).filter("m is not null").select(F.explode(F.sequence(F.lit(0), "m")).alias("value"))
    return bins.join(counts, "value", "left").fillna(0, ["n"])


def summary(df: DataFrame, values: Sequence[str]) -> DataFrame:
    """count, minimum, maximum, median, mean and population deviation of each value."""
    out = None
    for v in values:
        c = F.col(v)
        row = df.agg(F.lit(v).alias("value"), F.count(c).alias("n"), F.min(c).cast("double").alias("least"), F.max(c).cast("double").alias("most"), F.percentile(c, 0.5).alias("median"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("sd"))
        out = row if out is None else out.unionByName(row)
    return out


def drop_annotations(triples: DataFrame, predicates: Sequence[str] = ("label", "comment", "note", "seealso", "isdefinedby"), namespace: str = "skos") -> DataFrame:
    """Triples that annotate nothing: without annotation predicates and without terms of the annotation vocabulary's namespace."""
    touches = F.lower(F.concat_ws(" ", "s", "p", "o")).rlike(rf"(^|[ /:#(]){namespace}[:/#]")
    return triples.filter(~F.lower("p").isin(*predicates) & ~touches)


def within_length(df: DataFrame, length: str = "tokenized_length", most: int = 4096) -> DataFrame:
    """Rows of a known length of up to ``most``."""
    return df.filter(F.col(length) <= most)


def first_triples(triples: DataFrame, most: int, by: str = "onto") -> DataFrame:
    """An ontology's first ``most`` triples by position."""
    w = Window.partitionBy(by).orderBy("pos")
    return triples.withColumn("nth__", F.row_number().over(w)).filter(F.col("nth__") <= most).drop("nth__")


def order_triples(triples: DataFrame, by: str = "onto", how: str = "relation", seed: int = 0) -> DataFrame:
    """``place`` of each triple in its ontology from 0: by relation, then subject and object, or in hash order (``how="random"``)."""
    keys = ["p", "s", "o", "pos"] if how == "relation" else [F.md5(F.concat_ws(":", "s", "p", "o", F.lit(str(seed)))), "pos"]
    return triples.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*keys)) - 1)


def atom_ids(triples: DataFrame, order: Sequence[str] = ("onto", "pos")) -> DataFrame:
    """``(s, p, o, atom)``: every distinct triple numbered from 1 by its first appearance over all ontologies."""
    from truthframe.operators.fuzzy_logic import with_rank

    first = triples.groupBy("s", "p", "o").agg(F.min(F.struct(*order)).alias("at"))
    keyed = first.withColumn("key", F.struct("at", "s", "p", "o"))
    return with_rank(keyed, "key", "atom").select("s", "p", "o", "atom")


def activation_rates(bounds: DataFrame) -> DataFrame:
    """``(feature, rate)``: the mean lower bound of each feature of ``feature_bounds``."""
    return bounds.groupBy("feature").agg(F.avg("l").alias("rate"))
