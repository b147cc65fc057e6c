"""A term ontology as four tables, and set-at-a-time queries over them.

``concepts(src, cid, label, label_lower, label_norm)``, ``names(src, cid, name,
name_lower, name_norm, name_tok, kind)``, ``parents(src, child, parent)`` and
``tokens(src, tok, cid)``. Lookups take a table of terms, so a whole batch is
one plan instead of a query a term.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import possessive_fold, singular

MAX_DEPTH = 4
RARITY = 2
WEIGHT = {"FULL": 1.0, "CORE": 0.85, "PARTIAL": 0.5, "NONE": 0.0}
_WORDS = "[a-z0-9]+"


def raw_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(_WORDS), F.lit(0))


def build(raw: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """The four tables from names (src, cid, name, kind, ord) and edges (src, child, parent).

    A concept's label is its first preferred name, else its first name that
    isn't a definition or id; names are unique by (src, cid, lower case, kind),
    the first kept; definitions give no tokens.
    """
    first = Window.partitionBy("src", "cid", F.lower("name"), "kind").orderBy("ord")
    names = raw.where("trim(name) <> ''").withColumn("_n", F.row_number().over(first)).where("_n = 1").select(
        "src", "cid", "name", "kind", "ord", F.lower("name").alias("name_lower"), possessive_fold("name").alias("name_norm"), F.concat(F.lit(" "), F.array_join(raw_tokens(F.col("name")), " "), F.lit(" ")).alias("name_tok")
    )
    usable = names.where("kind not in ('def', 'id')")
    label = usable.groupBy("src", "cid").agg(F.min_by("name", F.struct((F.col("kind") != "pref").cast("int"), F.col("ord"))).alias("label"))
    concepts = label.withColumn("label_lower", F.lower("label")).withColumn("label_norm", possessive_fold("label"))
    each = usable.select("src", "cid", F.explode(raw_tokens(F.col("name"))).alias("t"))
    tokens = each.select("src", "cid", F.explode(F.array(F.col("t"), singular("t"))).alias("tok")).distinct()
    return {"concepts": concepts, "names": names, "parents": edges.distinct(), "tokens": tokens}


def _query_tokens(terms: DataFrame) -> DataFrame:
    return terms.select("term", F.explode(F.array_distinct(F.transform(raw_tokens(F.col("term")), singular))).alias("tok"))


def _classes(tokens: DataFrame) -> DataFrame:
    """(cid, held): the sorted tokens of every concept. Concepts of equal ``held`` are one class, and are looked up once."""
    return tokens.groupBy("cid").agg(F.array_sort(F.collect_set("tok")).alias("held"))


def _by_rarity(terms: DataFrame, classes: DataFrame) -> DataFrame:
    """(term, toks, rare): a term's distinct tokens, rarest first, and those of at most twice the least document frequency.

    ``classes`` has held and n, its number of concepts.
    """
    df = classes.select("n", F.explode("held").alias("tok")).groupBy("tok").agg(F.sum("n").alias("df"))
    asked = _query_tokens(terms).join(df.hint("merge"), "tok", "left").groupBy("term").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "tok"))).alias("t"))
    known = F.filter("t", lambda x: x["df"] > 0)
    rare = F.filter(known, lambda x: x["df"] <= RARITY * F.get(known, F.lit(0))["df"])
    return asked.select("term", F.transform("t", lambda x: x["tok"]).alias("toks"), F.transform(rare, lambda x: x["tok"]).alias("rare"))


def _candidates(asked: DataFrame, classes: DataFrame, least: Column) -> DataFrame:
    """(term, toks, rare, held, ...): the classes that may hold ``least`` of a term's n tokens.

    They hold one of its n + 1 - least rarest tokens, and are found under the
    rarest of those alone; so common tokens are not joined and no pair comes twice.
    """
    first = asked.withColumn("first", F.slice("toks", F.lit(1), F.size("toks") + 1 - least)).withColumn("tok", F.explode("first"))
    each = classes.withColumn("tok", F.explode("held"))
    return first.join(each.hint("merge"), "tok").where(F.get(F.array_intersect("first", "held"), F.lit(0)) == F.col("tok")).drop("tok", "first")


def _all_held(terms: DataFrame, classes: DataFrame) -> DataFrame:
    """(term, held): classes that carry every token of the term."""
    found = _candidates(_by_rarity(terms, classes), classes, F.size("toks"))
    return found.where(F.size(F.array_except("toks", "held")) == 0).select("term", "held")


def having_all(terms: DataFrame, tokens: DataFrame) -> DataFrame:
    """(term, cid): concepts that carry every token of the term (relational division)."""
    members = _classes(tokens)
    found = _all_held(terms, members.groupBy("held").agg(F.count("*").alias("n")))
    return found.join(members.hint("merge"), "held").select("term", "cid")


def best_covering(terms: DataFrame, tokens: DataFrame, concepts: DataFrame) -> DataFrame:
    """(term, cid): the concept that covers most tokens, all rare ones among them.

    At least half the tokens, rounded up; rare tokens have at most twice the
    least document frequency; ties go to the shortest label, then the least id.
    """
    # the least label of each concept that has one; a class without any is none's best, but may be the one that covers most
    label = concepts.groupBy("cid").agg(F.min(F.length("label")).alias("size"), F.lit(True).alias("named"))
    members = _classes(tokens).join(label.hint("merge"), "cid", "left")
    classes = members.groupBy("held").agg(F.count("*").alias("n"), F.min(F.when(F.col("named"), F.struct("size", "cid"))).alias("best"))
    found = _candidates(_by_rarity(terms, classes), classes, F.expr("(size(toks) + 1) div 2").cast("int"))
    rated = found.select("term", "best", F.size(F.array_intersect("toks", "held")).alias("cov"), (F.size(F.array_except("rare", "held")) == 0).alias("all_rare"), ((F.size("toks") + 1) / 2).cast("int").alias("least"))
    fit = rated.where("cov >= least").withColumn("top", F.max("cov").over(Window.partitionBy("term"))).where("cov = top and all_rare and best is not null")
    return fit.groupBy("term").agg(F.min("best").alias("b")).select("term", F.col("b.cid").alias("cid"))


def resolve(terms: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(term, cid, match): the first rung of the ladder that names one concept of a source.

    Preferred title in lower case; its normal form; the one concept with all
    tokens and the phrase in a name; the best covering concept; the phrase in a
    definition.
    """
    terms = terms.select("term").distinct()
    names, concepts = tables["names"], tables["concepts"]
    pref = names.where("kind = 'pref'")
    t = terms.withColumn("low", F.lower(F.trim("term"))).withColumn("norm", possessive_fold("term")).withColumn("phrase", F.concat(F.lit(" "), F.array_join(raw_tokens(F.col("term")), " "), F.lit(" ")))
    # names that concepts share are joined once
    titles = lambda key: pref.groupBy(key).agg(F.min("cid").alias("cid")).hint("merge")
    exact = t.join(titles("name_lower"), F.col("low") == F.col("name_lower")).select("term", "cid").withColumn("rung", F.lit(1)).withColumn("match", F.lit("exact_title"))
    normal = t.join(titles("name_norm"), F.col("norm") == F.col("name_norm")).select("term", "cid").withColumn("rung", F.lit(2)).withColumn("match", F.lit("normalized_title"))
    members = _classes(tables["tokens"])
    named = names.where("kind <> 'id'").select("cid", "name_tok").join(members.hint("merge"), "cid").groupBy("held", "name_tok").agg(F.min("cid").alias("cid"), F.max("cid").alias("other")).hint("merge")
    phrased = _all_held(terms, members.groupBy("held").agg(F.count("*").alias("n"))).join(t.hint("merge"), "term").join(named, "held").where(F.contains("name_tok", "phrase")).groupBy("term").agg(F.min("cid").alias("cid"), F.max("other").alias("other")).where("cid = other").drop("other")
    synonym = phrased.withColumn("rung", F.lit(3)).withColumn("match", F.lit("synonym_title"))
    fuzzy = best_covering(terms, tables["tokens"], concepts).withColumn("rung", F.lit(4)).withColumn("match", F.lit("top_hit_fuzzy"))
    defs = names.where("kind = 'def'").select("cid", "name_tok", F.explode(F.array_distinct(raw_tokens(F.col("name")))).alias("tok"))
    first = t.where(F.length(F.replace("phrase", F.lit(" "))) >= 6).withColumn("tok", F.element_at(raw_tokens(F.col("term")), 1))
    mention = first.join(defs.hint("merge"), "tok").where(F.contains("name_tok", "phrase")).join(concepts.select("cid", "label").hint("merge"), "cid").groupBy("term").agg(F.min_by("cid", F.struct(F.length("label"), F.col("cid"))).alias("cid")).withColumn("rung", F.lit(5)).withColumn("match", F.lit("def_mention"))
    rungs = exact.unionByName(normal).unionByName(synonym).unionByName(fuzzy).unionByName(mention)
    return rungs.groupBy("term").agg(F.min_by(F.struct("cid", "match"), F.struct("rung", "cid")).alias("m")).select("term", "m.cid", "m.match")


def resolve_by_label(terms: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(term, cid, match) by the label-first ladder: label; normal label that is also a name; any
    name, shortest label first; normal label; best covering concept."""
    terms = terms.select("term").distinct()
    concepts, names = tables["concepts"], tables["names"].where("kind not in ('def', 'id')")
    t = terms.withColumn("low", F.lower(F.trim("term"))).withColumn("norm", possessive_fold("term"))
    pick = F.min_by("cid", F.struct(F.length("label"), F.col("label"), F.col("cid"))).alias("cid")
    rung = lambda df, n, m: df.groupBy("term").agg(pick).withColumn("rung", F.lit(n)).withColumn("match", F.lit(m))
    one = rung(t.join(concepts, F.col("low") == F.col("label_lower")), 1, "label")
    named = t.join(names.select("name_lower").distinct(), F.col("low") == F.col("name_lower"), "left_semi")
    two = rung(named.join(concepts, F.col("norm") == F.col("label_norm")), 2, "label")
    three = rung(t.join(names.select("cid", "name_lower"), F.col("low") == F.col("name_lower")).join(concepts, "cid"), 3, "exact_synonym")
    four = rung(t.join(concepts, F.col("norm") == F.col("label_norm")), 4, "normalized_label")
    five = best_covering(terms, tables["tokens"], concepts).withColumn("rung", F.lit(5)).withColumn("match", F.lit("top_hit_fuzzy"))
    every = one.unionByName(two).unionByName(three).unionByName(four).unionByName(five)
    return every.groupBy("term").agg(F.min_by(F.struct("cid", "match"), F.struct("rung", "cid")).alias("m")).select("term", "m.cid", "m.match")


def ancestors(starts: DataFrame, parents: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """(cid, ancestor, depth): least depth of every ancestor within so many steps.

    A level holds each (concept, ancestor) once, however many paths lead there;
    cycles end with the depth, and the start can return as its own ancestor
    through one.
    """
    edges = parents.select("child", "parent").distinct()
    level, found = starts.select("cid").distinct().withColumn("ancestor", F.col("cid")), []
    for d in range(1, depth + 1):
        level = level.join(edges, F.col("ancestor") == F.col("child")).select("cid", F.col("parent").alias("ancestor")).distinct()
        found.append(level.withColumn("depth", F.lit(d)))
    return reduce(DataFrame.unionByName, found).groupBy("cid", "ancestor").agg(F.min("depth").alias("depth"))


def typed_siblings(pairs: DataFrame, parents: DataFrame, subtype: str, disorder: str) -> DataFrame:
    """(a, b, shared): pairs whose sides are both typed as subtypes and share a parent typed as a disorder."""
    typed = lambda mark: parents.where(F.col("parent") == mark).select(F.col("child").alias("x")).distinct()
    up = parents.select("child", "parent")
    a, b = up.alias("a"), up.alias("b")
    both = pairs.select("a", "b").distinct().join(a, F.col("a") == F.col("a.child")).join(b, (F.col("b") == F.col("b.child")) & (F.col("a.parent") == F.col("b.parent"))).select(pairs["a"], pairs["b"], F.col("a.parent").alias("shared"))
    return both.join(typed(subtype), both["a"] == F.col("x"), "left_semi").join(typed(subtype), both["b"] == F.col("x"), "left_semi").join(typed(disorder), F.col("shared") == F.col("x"), "left_semi").groupBy("a", "b").agg(F.min("shared").alias("shared"))


def relations(pairs: DataFrame, parents: DataFrame, typed: DataFrame | None = None, depth: int = MAX_DEPTH) -> DataFrame:
    """(a, b, relation, depth, depth_a, depth_b) of pairs of concept ids; null ids are unmapped."""
    pairs = pairs.select("a", "b").distinct()
    up = ancestors(pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).where("cid is not null"), parents, depth)
    of = lambda side, n: up.select(F.col("cid").alias(side), F.col("ancestor").alias(f"{n}_anc"), F.col("depth").alias(f"{n}_depth"))
    above = pairs.join(up.select(F.col("cid").alias("a"), F.col("ancestor").alias("b"), F.col("depth").alias("ab")), ["a", "b"], "left").join(up.select(F.col("cid").alias("b"), F.col("ancestor").alias("a"), F.col("depth").alias("ba")), ["a", "b"], "left")
    shared = pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").where("x_anc = y_anc").groupBy("a", "b").agg(F.min_by(F.struct(F.col("x_depth").alias("da"), F.col("y_depth").alias("db")), F.struct(F.col("x_depth") + F.col("y_depth"), F.col("x_anc"))).alias("near"), F.max((F.col("x_depth") == 1) & (F.col("y_depth") == 1)).alias("sibling"))
    out = above.join(shared, ["a", "b"], "left")
    out = out.join(typed.select("a", "b", F.lit(True).alias("typed")), ["a", "b"], "left") if typed is not None else out.withColumn("typed", F.lit(False))
    relation = (
        F.when(F.col("a").isNull() | F.col("b").isNull(), "unmapped").when(F.col("a") == F.col("b"), "equivalent").when(F.col("ab").isNotNull(), "a_subtype_of_b").when(F.col("ba").isNotNull(), "b_subtype_of_a")
        .when(F.coalesce("typed", F.lit(False)), "subtype_siblings").when(F.coalesce("sibling", F.lit(False)), "siblings").when(F.col("near").isNotNull(), "distant").otherwise("unrelated")
    )
    distant = F.col("relation") == "distant"
    return out.withColumn("relation", relation).select(
        "a", "b", "relation", F.when(F.col("relation") == "a_subtype_of_b", F.col("ab")).when(F.col("relation") == "b_subtype_of_a", F.col("ba")).alias("depth"), F.when(distant, F.col("near.da")).alias("depth_a"), F.when(distant, F.col("near.db")).alias("depth_b")
    )


def vote(legs: DataFrame, key: list[str]) -> DataFrame:
    """Verdict, weight and confidence of each pair from its sources' relations."""
    n = lambda *r: F.count_if(F.col("relation").isin(*r))
    c = legs.groupBy(*key).agg(
        n("a_subtype_of_b").alias("down"), n("b_subtype_of_a").alias("up"), n("equivalent").alias("same"), n("subtype_siblings").alias("typed"), n("siblings").alias("sib"), F.count_if(F.col("relation") != "unmapped").alias("mapped")
    )
    hier = F.col("down") + F.col("up")
    both = (F.col("down") > 0) & (F.col("up") > 0)
    verdict = F.when(hier > 0, "CORE").when(F.col("typed") > 0, "CORE").when(F.col("same") > 0, "FULL").when(F.col("sib") >= 2, "PARTIAL").when(F.col("mapped") > 0, "NONE").otherwise("UNKNOWN")
    confidence = (
        F.when(hier > 0, F.when(both, "low").when((hier >= 2) | (F.col("same") == 0), "high").otherwise("medium")).when(F.col("typed") > 0, "medium").when(F.col("same") > 0, F.when(F.col("same") >= 2, "high").otherwise("low"))
        .when(F.col("sib") >= 2, "medium").when(F.col("mapped") > 0, F.when(F.col("mapped") >= 2, "high").otherwise("low")).otherwise("none")
    )
    weight = F.create_map(*[F.lit(x) for kv in WEIGHT.items() for x in kv])
    return c.withColumn("verdict", verdict).withColumn("confidence", confidence).withColumn("weight", weight[F.col("verdict")]).select(*key, "verdict", "confidence", "weight")


def head_term(c: Column, connectives: list[str]) -> Column:
    """The part of a compound term before its first qualifier."""
    padded = F.concat(F.lit(" "), F.trim(c), F.lit(" "))
    cut = F.array_min(F.filter(F.array(*[F.instr(F.lower(padded), s) for s in connectives]), lambda i: i > 1))
    return F.btrim(F.when(cut.isNull(), padded).otherwise(F.substring(padded, F.lit(1), cut - 1)), F.lit(" ,"))


def with_heads(first: DataFrame, heads: DataFrame) -> DataFrame:
    """Verdicts after the second pass: NONE and UNKNOWN become CORE where the head terms match.

    ``heads`` is (a, b, head_verdict, head_confidence), for the pairs whose heads differ from them.
    """
    hit = F.col("verdict").isin("NONE", "UNKNOWN") & F.col("head_verdict").isin("FULL", "CORE")
    up = F.coalesce(hit, F.lit(False))
    return first.join(heads, ["a", "b"], "left").withColumn("_up", up).select(
        "a", "b", F.when(F.col("_up"), "CORE").otherwise(F.col("verdict")).alias("verdict"),
        F.when(F.col("_up"), F.when(F.col("head_confidence") == "high", "medium").otherwise("low")).otherwise(F.col("confidence")).alias("confidence"), F.when(F.col("_up"), WEIGHT["CORE"]).otherwise(F.col("weight")).alias("weight"),
    )


def guarded_score(blank: Column, generic: Column, exact: Column, hedged: Column, verdict: Column, confidence: Column, depth: Column, by_head: Column, for_floor: bool = False) -> Column:
    """1 or 0 for an answer: guards first, then what the ontology's verdict pays for.

    CORE pays up to two steps of hierarchy, or without a depth; a floor may not
    rest on head terms that match.
    """
    core = (verdict == "CORE") & (depth.isNull() | (depth <= 2))
    paid = ((verdict == "FULL") & (confidence == "high")) | ((core & ~F.coalesce(by_head, F.lit(False))) if for_floor else core)
    return F.when(blank | generic, 0.0).when(exact, 1.0).when(hedged, 0.0).when(F.coalesce(paid, F.lit(False)), 1.0).otherwise(0.0)
