"""Parsers of model output: actions, item lists and grader replies.

The parsers run in Arrow batches. Verbs, aliases and vocabularies are
parameters, since every deployment has its own.
"""

from __future__ import annotations

import difflib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_REASONING = re.compile(r"<reasoning>(.*?)(?:</reasoning>|(?=<action>))", re.S | re.I)
_ACTION = re.compile(r"<action>(.*?)</action>", re.S | re.I)
_LINE = re.compile(r"\s*(gt_count|pred_count|matched)\s*:\s*(-?\d+)\s*$", re.I)


def canonical(name: str) -> str:
    """Lower case, words by single spaces, slashes tight."""
    return "/".join(" ".join(re.findall("[a-z0-9]+", level)) for level in name.lower().split("/"))


def _words(name: str) -> frozenset[str]:
    return frozenset(w for w in re.split(r"[ /]+", canonical(name)) if w)


@dataclass(frozen=True)
class Vocabulary:
    """Entries that items name, of one level or of ``level/name``, and the ways they may be misnamed.

    ``aliases`` give entries for an item's words, ``synonyms`` an entry's name
    below its level for other words, ``stop`` words that say nothing.
    """

    entries: tuple[str, ...]
    aliases: dict[str, tuple[str, ...]] = field(default_factory=dict)
    synonyms: dict[str, str] = field(default_factory=dict)
    stop: tuple[str, ...] = ()
    ratio: float = 0.85

    def _plain(self, item: str) -> str:
        return " ".join(w for w in re.split(r"[ /]+", canonical(item)) if w and w not in self.stop)

    def named(self, item: str) -> str | None:
        """The entry of the same canonical name, or the only one whose words include the item's."""
        words, same = _words(item), [v for v in self.entries if canonical(v) == canonical(item)]
        near = [v for v in self.entries if words and not words <= set(self.stop) and words <= _words(v)]
        return same[0] if same else near[0] if len(near) == 1 else None

    def _below(self, item: str) -> tuple[list[str], str | None]:
        """Entries by their name below a level: under the item's own level, or the only one, or all if it has no level."""
        level, _, last = canonical(item).rpartition("/")
        levels = {canonical(v.partition("/")[0]) for v in self.entries if "/" in v}
        said = self.synonyms.get(self._plain(last), self.synonyms.get(last))
        for name, tag in ((said, "item_synonym"), (last, "item_level"), (self._plain(last), "item_level")):
            found = [v for v in self.entries if "/" in v and name and canonical(v).rpartition("/")[2] == name]
            own = [v for v in found if canonical(v.partition("/")[0]) == level]
            if own or len(found) == 1 or found and level not in levels:
                return own or found, tag
        return [], None

    def _fuzzy(self, item: str) -> tuple[list[str], str | None]:
        names = {self._plain(v): (v,) for v in self.entries} | self.aliases
        names |= {canonical(v).rpartition("/")[2]: tuple(self._below(v.rpartition("/")[2])[0]) for v in self.entries if "/" in v}
        words = self._plain(item)
        near = difflib.get_close_matches(words, list(names), n=2, cutoff=self.ratio) if len(words) >= 5 else []
        return (list(names[near[0]]), "item_fuzzy") if len(near) == 1 and names[near[0]] else ([], None)

    def resolve(self, item: str) -> tuple[list[str], str | None]:
        """(entries, the rule that found them): no rule for an entry's own name, no entries if none does."""
        if entry := self.named(item):
            return [entry], None
        plain = self._plain(item)
        if plain in self.aliases:
            return list(self.aliases[plain]), "item_alias"
        if plain and (entry := self.named(plain)):
            return [entry], "item_stopword"
        found = self._below(item)
        if found[0]:
            return found
        halves = re.split(r"\band\b", canonical(item))
        if len(halves) > 1:
            each = [self.resolve(h)[0] if h.strip() else [] for h in halves]
            if all(each):
                return list(dict.fromkeys(e for x in each for e in x)), "item_split"
        return self._fuzzy(item)


def split_items(payload: str, vocabulary: Vocabulary, longest: int = 4) -> tuple[list[str], list[str], list[str]]:
    """(entries, unresolved parts, rules used) of a comma list whose entries may hold commas themselves.

    At each part the longest run of parts that names an entry is taken, else the
    part alone by the vocabulary's rules; an entry is listed once.
    """
    parts, found, lost, rules, at = [p.strip() for p in payload.split(",") if p.strip()], [], [], [], 0
    while at < len(parts):
        runs = ((n, vocabulary.named(", ".join(parts[at : at + n]))) for n in range(min(longest, len(parts) - at), 1, -1))
        n, entry = next(((n, e) for n, e in runs if e), (1, None))
        entries, rule = ([entry], None) if entry else vocabulary.resolve(parts[at])
        found += [e for e in entries if e not in found]
        lost += [] if entries else [parts[at]]
        rules += [rule] if rule and rule not in rules else []
        at += n
    return found, lost, rules


@dataclass(frozen=True)
class Grammar:
    """The verbs of an action language and how misspelt ones are read."""

    verbs: tuple[str, ...]
    aliases: dict[str, str] = field(default_factory=dict)
    lists: dict[str, Vocabulary] = field(default_factory=dict)
    need_payload: tuple[str, ...] = ()
    #: (pattern of a verb, verb, what the payload is without one of its own)
    prefixes: tuple[tuple[str, str, str], ...] = ()
    #: (pattern of a whole body, verb): the body is the payload
    bare: tuple[tuple[str, str], ...] = ()
    #: verb -> names that its payload may have, and other names for them
    names: dict[str, dict[str, str]] = field(default_factory=dict)
    quoted: tuple[str, ...] = ()
    ratio: float = 0.85

    def repairs(self) -> list[tuple[str, Callable[[str, str], tuple[str, str]]]]:
        """(tag, reading) in order: a reading makes (verb, payload) of the raw head and the whole body."""

        def spelled(head, rest, _):
            return re.sub(r"[\s-]+", "_", head.strip()).lower().rstrip(".!;_"), rest

        def unwrapped(head, rest, _):
            return head.strip("<>/ ").lower().replace(" ", "_"), rest

        def cut(pattern):
            def read(head, rest, body):
                m = re.match(pattern, body.strip())
                return (spelled(m[1], "", "")[0], m[2].strip()) if m else ("", rest)

            return read

        def alias(head, rest, _):
            return self.aliases.get(spelled(head, "", "")[0], ""), rest

        def bare(head, rest, body):
            return next(((v, body) for p, v in self.bare if re.match(p, body, re.I)), ("", rest))

        def prefix(head, rest, _):
            word = spelled(head, "", "")[0]
            hits = ((re.match(p, word), v, t) for p, v, t in self.prefixes)
            return next(((v, rest or m.expand(t).replace("_", " ")) for m, v, t in hits if m and (rest or t)), ("", rest))

        def level(head, rest, _):
            """A list's level in the verb's place."""
            for verb, vocabulary in self.lists.items():
                levels = {canonical(e.partition("/")[0]): e.partition("/")[0] for e in vocabulary.entries if "/" in e}
                if (name := levels.get(canonical(head))) and rest:
                    return verb, ", ".join(i.strip() if "/" in i else f"{name}/{i.strip()}" for i in rest.split(",") if i.strip())
            return "", rest

        def close(head, rest, _):
            word = spelled(head, "", "")[0]
            near = difflib.get_close_matches(word, [*self.verbs, *self.aliases], n=2, cutoff=self.ratio) if len(word) >= 5 else []
            return (self.aliases.get(near[0], near[0]) if len(near) == 1 else ""), rest

        readings = [("", lambda h, r, b: (h.strip(), r)), ("spelling", spelled), ("xml", unwrapped), ("bare", bare), ("dash", cut(r"([A-Za-z_ ]+?)\s+[-–—]\s*(.+)$"))]
        readings += [("alias", alias), ("prefix", prefix), ("level", level), ("glued", cut(r"([A-Za-z_]+)[=(>\[]+(.+?)[)\]>]*$")), ("no_colon", cut(r"([A-Za-z]+_[A-Za-z_]+)\s+(.+)$")), ("fuzzy", close)]
        return readings

    def payload(self, verb: str, payload: str) -> tuple[str, list[str]]:
        """(the payload, tags): quotes around the whole of it dropped, a name's other spelling resolved."""
        tags = []
        if verb in self.quoted and len(payload) > 1 and payload[0] in "\"'" and payload[-1] == payload[0] and payload[0] not in payload[1:-1]:
            payload, tags = payload[1:-1].strip(), ["quotes"]
        known = self.names.get(verb)
        if known and payload and (name := payload.strip().lower()) not in known.values():
            near = difflib.get_close_matches(name, [*known.values()], n=2, cutoff=self.ratio)
            other = known.get(name) or (near[0] if len(near) == 1 else None)
            payload, tags = (other, [*tags, "name"]) if other else (payload, tags)
        return payload, tags

    def parse(self, text: str | None) -> dict:
        """think, verb, payload, items, error, tags and dropped of one reply."""
        out = {"think": "", "verb": "", "payload": None, "items": None, "error": None, "tags": [], "dropped": []}
        think, action = _REASONING.search(text or ""), _ACTION.search(text or "")
        if not think or not think[1].strip():
            return out | {"error": "no reasoning"}
        out["think"] = think[1].strip()
        if not action:
            return out | {"error": "no action"}
        body = " ".join(action[1].split())
        head, _, rest = body.partition(":")
        for tag, read in self.repairs():
            verb, payload = read(head, rest.strip(), body)
            if verb in self.verbs:
                payload, more = self.payload(verb, payload)
                out |= {"verb": verb, "payload": payload, "tags": [t for t in (tag, *more) if t]}
                break
        else:
            return out | {"verb": head.strip().lower(), "error": "unknown action"}
        if verb in self.lists:
            found, lost, rules = split_items(payload, self.lists[verb])
            error = "empty list" if not found and not lost else "unknown item" if not found else None
            return out | {"items": found, "dropped": lost, "error": error, "tags": [*out["tags"], *rules]}
        return out | {"error": "no payload" if verb in self.need_payload and not payload else None}

    def column(self):
        """The parser as a function of a text column."""

        @F.pandas_udf(_PARSED)
        def run(s: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([self.parse(t) for t in s], columns=_PARSED.names)

        return run


_PARSED = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("think", "verb", "payload")] + [T.StructField("items", T.ArrayType(T.StringType())), T.StructField("error", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("dropped", T.ArrayType(T.StringType()))]
)


def reply_counts(reply: str | None) -> tuple[int, int, int]:
    """(gt, pred, matched) of a grader's reply: its JSON object, or else its ``name: n`` lines.

    Counts are at least 1, matches between 0 and both; a reply without numbers is (1, 1, 0).
    """
    text = reply or ""
    a, b = text.find("{"), text.rfind("}")
    given: dict = {}
    if 0 <= a < b:
        try:
            found = json.loads(text[a : b + 1])
            matches = found.get("matches")
            given = {k: int(found[k]) for k in ("gt_count", "pred_count", "matched") if k in found}
            given |= {"matched": len(matches)} if isinstance(matches, list) else {}
        except (ValueError, TypeError, AttributeError):
            given = {}
    given = given or {m[1].lower(): int(m[2]) for m in map(_LINE.match, text.splitlines()) if m}
    gt, pred = max(1, given.get("gt_count", 1)), max(1, given.get("pred_count", 1))
    return gt, pred, max(0, min(given.get("matched", 0), gt, pred))


@F.pandas_udf(T.StructType([T.StructField(n, T.IntegerType()) for n in ("gt", "pred", "matched")]))
def grader_counts(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([reply_counts(t) for t in s], columns=["gt", "pred", "matched"])


_EDGES = " \t-:;,.•'\""
_PLAIN = str.maketrans({"’": "'", "–": "-", "—": "-", "×": "x"})


def _without_brackets(t: str) -> str:
    """The text with each closed bracket and what it holds replaced by a space."""
    out, at = [], 0
    while at < len(t):
        close = t.find({"(": ")", "[": "]"}[t[at]], at) if t[at] in "([" else -1
        out.append(" " if close >= 0 else t[at])
        at = max(at, close) + 1
    return "".join(out)


def _is_plain(ch: str) -> bool:
    return ch.isascii() and ch.isalnum()


def surface_form(qualifiers: list[str], spellings: list[tuple[str, str]], rounds: int = 4):
    """A function of a text column: NFKC, no brackets, one spelling, qualifiers at either end dropped.

    ``qualifiers`` are phrases in lower case; ``spellings`` are (pattern,
    replacement) in order. A round drops one phrase at each end, and a name that
    is nothing but qualifiers keeps the last of them.
    """
    import unicodedata

    phrases = sorted((q.split() for q in qualifiers), key=len, reverse=True)

    def dropped(words: list[str]) -> list[str]:
        lead = next((len(q) for q in phrases if len(q) < len(words) and [*words[: len(q) - 1], words[len(q) - 1].rstrip(",-")] == q), 0)
        words = words[lead:]
        last = next((len(q) for q in phrases if len(q) < len(words) and words[-len(q) :] == q), 0)
        return words[: len(words) - last]

    def one(t: str | None) -> str:
        t = unicodedata.normalize("NFKC", t or "").translate(_PLAIN).lower()
        t = " ".join(_without_brackets(t).split()).strip(_EDGES)
        inner = [k for k, ch in enumerate(t) if ch == "-" and _is_plain(t[k - 1]) and _is_plain(t[k + 1])]
        chars = list(t)
        for k in inner:
            chars[k] = " "
        t = "".join(chars)
        for pattern, to in spellings:
            t = re.sub(pattern, to, t)
        words = t.split()
        for _ in range(rounds):
            before, words = words, " ".join(dropped(words)).strip(_EDGES).split()
            if words == before:
                break
        return " ".join(words)

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return run


AGE_UNITS = ("year", "yr", "month", "week", "day")
PERSONS = ("man", "woman", "male", "female", "boy", "girl", "patient", "infant", "child", "adult", "person", "men", "women", "children")
ARTICLES = ("a", "an", "the", "this", "our", "another")
PREPOSITIONS = ("from", "in", "of", "for", "on")
_AGE = "\u0001"


def without_person(c, units: tuple[str, ...] = AGE_UNITS, persons: tuple[str, ...] = PERSONS, between: int = 3):
    """A study name without its first "<n> <unit> old ... <person>" phrase; the name itself if no letter would be left.

    The age is marked, and the words around it decide: the person is one of the
    next words, with at most ``between`` others before it, and an article and a
    preposition right before the age go too.
    """
    clean = lambda w: F.lower(F.regexp_replace(w, "[^A-Za-z'-]", ""))
    among = lambda w, names: F.coalesce(clean(w).isin(*names), F.lit(False))
    halves = F.split(F.regexp_replace(c, rf"(?i)\d+[ -]*(?:{'|'.join(units)})s?[ -]*old\b", _AGE), _AGE, 2)
    head, tail = F.filter(F.split(halves[0], " "), lambda w: clean(w) != ""), F.filter(F.split(F.get(halves, F.lit(1)), " "), lambda w: w != "")
    person = F.array_position(F.transform(F.slice(tail, 1, between + 1), lambda w: among(w, [*persons, *(f"{p}s" for p in persons)])), True)
    size = F.size(head)
    no_article = F.slice(head, 1, size - F.when(among(F.get(head, size - 1), ARTICLES), 1).otherwise(0))
    size = F.size(no_article)
    before = F.slice(no_article, 1, size - F.when(among(F.get(no_article, size - 1), PREPOSITIONS), 1).otherwise(0))
    left = F.btrim(F.array_join(F.concat(before, F.slice(tail, person.cast("int") + 1, F.size(tail) + 1)), " "), F.lit(" ,;:"))
    return F.when((F.size(halves) > 1) & (person > 0) & left.rlike("[A-Za-z]"), left).otherwise(c)
