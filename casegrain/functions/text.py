"""Text functions as columns; Arrow functions only where Spark has no expression.

Patterns take ``(?U)`` where a class must be Unicode. A null text counts as empty
unless a function says otherwise.
"""

from __future__ import annotations

import difflib
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: tokens that name a category or a place, not a disease
GENERIC_TOKENS = (
    "disease diseases disorder disorders syndrome syndromes condition conditions tumor tumour tumors tumours neoplasm neoplasms carcinoma carcinomas cancer cancers malignancy malignancies lesion lesions infection infections "
    "deficiency deficiencies genetic congenital inflammatory infectious autoimmune acute chronic severe mild primary secondary idiopathic familial hereditary rare benign malignant type types form forms i ii iii iv v 1 2 3 4 5 of "
    "the and with due to in a an or unspecified"
).split()
LOCATION_TOKENS = (
    "left right bilateral upper lower pulmonary lung lungs hepatic liver renal kidney kidneys cardiac heart cerebral brain spinal cord cutaneous skin breast gastric stomach colon colonic rectal rectum ovarian uterine cervical "
    "cervix thyroid adrenal bone bones soft tissue central nervous system head neck pelvic abdominal thoracic chest ocular eye eyes oral"
).split()
# fixed values: phrases that hedge an answer, and words that say nothing about a question's topic
HEDGES = ("most likely", "most probable", "probable", "probably", "likely", "possible", "possibly", "suspected", "presumed", "presumptive", "consistent with", "rule out", "r/o")
ASK_STOP = (
    "a an and any are as at be been being but can could describe did do does els else ever feel felt for from get had has have having how i if in is it its just like me more most notice noticed of on or other please recall recent "
    "recently share specifically tell that the them then there these they this those to us was we were what when where whether which with would you your"
).split()
#: Least share of tokens in common at which two names match.
NAME_JACCARD = 0.5
FUZZY_RATIO = 0.85


def text(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit(""))


def strings(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def normalize(c) -> Column:
    """Lower case, anything but a-z, 0-9 and white space to a space, runs to one, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text(c)), r"[^a-z0-9\s]+", " "), r"\s+", " "))


def tokens(c) -> Column:
    """Words of an already normalised text; none for the empty text."""
    return F.filter(F.split(c, " "), lambda w: w != "")


def lexical_match(truth, given) -> Column:
    """1.0 if one normalised name holds the other or half their distinct tokens agree, else 0.0."""
    a, b = normalize(truth), normalize(given)
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    share = F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y)).cast("double"))
    return F.when((a == "") | (b == ""), 0.0).when(F.contains(b, a) | F.contains(a, b), 1.0).when(share >= NAME_JACCARD, 1.0).otherwise(0.0)


def same_name(truth, given) -> Column:
    """1.0 if both normalise to the same text, as two empty ones do."""
    return (normalize(truth) == normalize(given)).cast("double")


def informative_tokens(c) -> Column:
    """Tokens left without categories and places, in order."""
    stop = strings([*GENERIC_TOKENS, *LOCATION_TOKENS])
    return F.filter(tokens(normalize(c)), lambda w: ~F.array_contains(stop, w))


def strip_hedges(c) -> Column:
    """The text without hedging phrases and the separators they leave at its ends."""
    phrases = "|".join(HEDGES)
    bare = F.regexp_replace(F.regexp_replace(text(c), rf"(?iU)\b(?:{phrases})\b|\?", " "), r"(?U)\s+", " ")
    return F.btrim(bare, F.lit(" ,;:-"))


def first_rule(c, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the first pattern found in the text, ignoring case."""
    subject, out = text(c), None
    for pattern, label in rules:
        hit = subject.rlike(f"(?iu){pattern}")
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def possessive_fold(c) -> Column:
    """Lower case without possessives and the punctuation ``,.-/()``, single spaces."""
    bare = F.regexp_replace(F.replace(F.trim(F.lower(text(c))), F.lit("’"), F.lit("'")), "'s( |$)", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[,.\-/()]", " "), r"\s+", " "))


def singular(c) -> Column:
    """A word of four letters or more without its final s, unless it ends in ss."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.endswith(c, F.lit("s")) & ~F.endswith(c, F.lit("ss")) & (F.length(c) > 3), F.substring(c, F.lit(1), F.length(c) - 1)).otherwise(c)


def name_tokens(c) -> Column:
    """Distinct singular alphanumeric tokens of a name."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(text(c)), F.lit("[a-z0-9]+"), F.lit(0)), singular))


def model_key(c) -> Column:
    """The last segment of a path-like model name, lower case."""
    return F.lower(F.element_at(F.split(text(c), "/"), -1))


def assert_no_self_grading(records: DataFrame, model: str, graders: list[str]) -> None:
    """Raise where a record's model is one of its graders."""
    keys = [g.split("/")[-1].lower() for g in graders]
    found = records.where(model_key(model).isin(*keys)).select(model).limit(1).collect()
    if found:
        raise ValueError(f"{found[0][0]} would grade itself")


def pick_field(*names: str) -> Column:
    """The first of the columns that isn't blank, trimmed; empty if all are."""
    return F.coalesce(*[F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names], F.lit(""))


def tagged(c, tag: str, strict: bool = False) -> Column:
    """What ``[TAG: …]`` holds, ignoring case; without the tag the trimmed text, or null if strict."""
    found = F.nullif(F.regexp_extract(text(c), rf"(?i)\[{tag}:\s*(.+?)\]", 1), F.lit(""))
    return F.trim(found) if strict else F.coalesce(F.trim(found), F.trim(text(c)))


def ask_words(c) -> Column:
    """Distinct words of three letters or more of a question, without common ones."""
    stop = strings(ASK_STOP)
    words = F.regexp_extract_all(F.lower(text(c)), F.lit("[a-z]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w)))


def overlap(a: Column, b: Column) -> Column:
    """Overlap coefficient of two word sets; 0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), least.cast("double")), F.lit(0.0))


def flags(**patterns: Column) -> Column:
    """Names of the conditions that hold, in the order given."""
    return F.array_compact(F.array(*[F.when(hit, name) for name, hit in patterns.items()]))


def injection_flags(c, json_shape: str, keyword: str, role: str, instruction: str, most: int = 600) -> Column:
    """Which shapes of a text could steer a grader; patterns are parameters."""
    t = text(c)
    return flags(json_shape=t.rlike(json_shape), rubric_keyword=t.rlike(keyword), role_marker=t.rlike(role), instruction=t.rlike(instruction), long=F.length(t) > most)


def fill(template: str, **slots: Column) -> Column:
    """A template with its ``{slot}`` texts put in."""
    out = F.lit(template)
    for name, value in slots.items():
        out = F.replace(out, F.lit("{" + name + "}"), text(value))
    return out


def gate_reply(c) -> Column:
    """struct(think, verdict, axes, reason, error) of a tagged review reply."""
    t = text(c)
    think = F.trim(F.regexp_extract(t, r"(?is)<reasoning>(.*?)</reasoning>", 1))
    has = t.rlike(r"(?is)<action>.*?</action>")
    body = F.trim(F.regexp_replace(F.regexp_extract(t, r"(?is)<action>(.*?)</action>", 1), r"\s+", " "))
    head = F.lower(body).startswith("gate_verdict")
    payload = F.trim(F.regexp_extract(body, r"^[^:]*:(.*)$", 1))
    low = F.lower(payload)
    passed, mismatch = low.startswith("pass"), low.startswith("mismatch")
    none = F.array().cast("array<string>")
    verdict = F.when(~has | ~head, "").when(passed, "pass").when(mismatch, "mismatch").otherwise("")
    axes = F.when(verdict == "mismatch", flags(modality=low.rlike(r"\bmodality\b"), anatomy=low.rlike(r"\banatomy\b"))).otherwise(none)
    reason = F.when(verdict == "mismatch", F.trim(F.regexp_extract(payload, r"(?i)reason\s*:\s*(.*)$", 1))).otherwise("")
    error = F.when(~has, "no action block").when(~head, "not a gate verdict").when(~passed & ~mismatch, "unknown verdict")
    return F.struct(think.alias("think"), verdict.alias("verdict"), axes.alias("axes"), reason.alias("reason"), error.alias("error"))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition, which Spark has no expression for."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StringType())
def nfkd(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x))


@F.pandas_udf(T.StringType())
def first_object(s: pd.Series) -> pd.Series:
    """The first balanced ``{…}`` of a reply, braces inside JSON strings apart; null if there is none."""

    def scan(t: str | None) -> str | None:
        depth, start, quoted, escaped = 0, -1, False, False
        for i, ch in enumerate(t or ""):
            if depth and quoted:
                quoted, escaped = (ch != '"' or escaped), ch == "\\" and not escaped
            elif ch == '"' and depth:
                quoted = True
            elif ch == "{":
                start, depth = (i, 1) if not depth else (start, depth + 1)
            elif ch == "}" and depth:
                depth -= 1
                if not depth:
                    return t[start : i + 1]
        return None

    return s.map(scan)


# fixed values: levels of a grader's row that say it matches nothing
NO_MATCH = ("none", "no match", "no_match", "nomatch", "unrelated", "different", "discrepant", "mismatch", "no-match", "not matched", "unmatched")


def without_thoughts(c) -> Column:
    """A reply without its closed think blocks, and without all that follows one left open."""
    return F.regexp_replace(F.regexp_replace(text(c), r"(?is)<think>.*?</think>", ""), r"(?is)<think>.*", "")


def reply_object(c) -> Column:
    """The JSON object of a reply, thoughts apart: the fenced one, or else the first balanced one; null if there is none."""
    said = without_thoughts(c)
    fenced = F.nullif(F.regexp_extract(said, r"(?is)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    return F.coalesce(fenced, first_object(said))


def reply_matches(c) -> Column:
    """(level, gt, pred) rows of a grader's reply without those that match nothing; null if there is no object."""
    found = F.from_json(reply_object(c), "matches array<struct<level:string,gt:string,pred:string>>")["matches"]
    return F.filter(found, lambda m: ~F.coalesce(F.lower(F.trim(m["level"])), F.lit("")).isin(*NO_MATCH))


@F.pandas_udf(T.StructType([T.StructField("sentences", T.IntegerType()), T.StructField("questions", T.IntegerType())]))
def ask_shape(s: pd.Series) -> pd.DataFrame:
    """Sentences outside brackets, and question marks anywhere."""

    def shape(t: str | None) -> tuple[int, int]:
        depth, filled, n = 0, False, 0
        for ch in t or "":
            depth = depth + 1 if ch in "([{" else max(0, depth - 1) if ch in ")]}" else depth
            if ch in ".?!" and not depth:
                n, filled = n + filled, False
            else:
                filled = filled or not ch.isspace()
        return n + filled, (t or "").count("?")

    return pd.DataFrame([shape(t) for t in s], columns=["sentences", "questions"])


def close_match(vocabulary: list[str], ratio: float = FUZZY_RATIO):
    """A function of a word column: the one vocabulary word within the difflib ratio, or null."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        def one(w: str | None) -> str | None:
            if w is None or len(w) < 5:
                return None
            found = difflib.get_close_matches(w, vocabulary, n=2, cutoff=ratio)
            return found[0] if len(found) == 1 else None

        return s.map(one)

    return run
