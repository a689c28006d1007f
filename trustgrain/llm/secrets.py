"""Secret scan: trigram queries derived from the rules choose the texts, the rules find the spans in them."""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from re import _constants as ops
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import fresh


@dataclass(frozen=True)
class Rule:
    """``regex`` (Java syntax, of the part that Python's ``re`` shares); a match counts only where the captured
    ``group`` has at least ``least`` characters. Matches are leftmost and do not overlap."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


#: In the order in which spans with the same start are listed; the first three are the base kinds.
BASE = ("assign", "access", "hex")
RULES = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]+", least=24),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("host_token", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", least=20),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)

#: Strings that a part of a regex can be are listed while they are at most so many.
MOST_STRINGS = 16

#: A trigram query in conjunctive form: each part is a set of alternatives, each alternative a set of trigrams.
Query = tuple[frozenset[frozenset[str]], ...]


def _part(strings: set[str]) -> list[frozenset[frozenset[str]]]:
    """The condition that one of ``strings`` occurs, as far as trigrams can tell; none if one of them is too short."""
    if not strings or any(len(s) < 3 for s in strings):
        return []
    return [frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)]


def _strings(node) -> set[str] | None:
    """All strings that a node of a parsed regex matches, lower-cased, if they are few."""
    op, value = node
    if op is ops.LITERAL:
        return {chr(value).lower()}
    if op is ops.IN:
        found: set[str] = set()
        for kind, x in value:
            if kind is ops.LITERAL:
                found.add(chr(x).lower())
            elif kind is ops.RANGE and x[1] - x[0] < MOST_STRINGS:
                found |= {chr(i).lower() for i in range(x[0], x[1] + 1)}
            else:
                return None
        return found if len(found) <= MOST_STRINGS else None
    if op is ops.SUBPATTERN:
        return _sequence(value[3])
    if op is ops.BRANCH:
        each = [_sequence(x) for x in value[1]]
        return None if None in each else set().union(*each)
    if op is ops.MAX_REPEAT and value[1] == 1:
        once = _sequence(value[2])
        return None if once is None else once | ({""} if value[0] == 0 else set())
    return None


def _sequence(nodes) -> set[str] | None:
    found = {""}
    for node in nodes:
        more = _strings(node)
        if more is None or len(found) * len(more) > MOST_STRINGS:
            return None
        found = {a + b for a, b in itertools.product(found, more)}
    return found


def _parts(nodes) -> list[frozenset[frozenset[str]]]:
    parts: list[frozenset[frozenset[str]]] = []
    current = {""}
    for node in nodes:
        strings = _strings(node)
        if strings is not None and len(current) * len(strings) <= MOST_STRINGS:
            current = {a + b for a, b in itertools.product(current, strings)}
            continue
        parts += _part(current)
        current = {""} if strings is None else strings
        if strings is None and node[0] is ops.SUBPATTERN:
            parts += _parts(node[1][3])
    return parts + _part(current)


def trigram_query(regex: str) -> Query:
    """What the trigrams of a lower-cased text must satisfy if ``regex`` matches anywhere in it.

    Neighbouring parts of the regex with few possible strings are multiplied out; where a part is open (a long class, a
    repetition), the strings gathered so far are required: one of them, with all its trigrams. A part whose strings may
    be shorter than three characters requires nothing. An empty query means that every text has to be scanned.
    """
    return tuple(_parts(_parser.parse(regex)))


def _trigrams(queries: dict[str, Query]) -> list[str]:
    return sorted({t for q in queries.values() for part in q for strings in part for t in strings})


def postings(texts: DataFrame, trigrams: list[str], key: str, text: str) -> DataFrame:
    """The inverted index ``(trigram, key)``: one row per trigram and key whose lower-cased text has the trigram.

    Only trigrams that some rule requires are indexed, so a text has at most that many rows however long it is.
    """
    low = fresh(texts, "lowered")
    has = [F.when(F.contains(F.col(low), F.lit(t)), F.lit(t)) for t in trigrams]
    found = F.explode(F.array_compact(F.array(*has)))
    return texts.withColumn(low, F.lower(text)).select(F.col(key), found.alias("trigram")).distinct()


def candidates(index: DataFrame, queries: dict[str, Query], key: str) -> DataFrame:
    """``(key, kinds)``: the rules whose trigram query holds, for keys that have any; the intersection of postings.

    The posting lists of a key meet in one row, a set of at most as many trigrams as are indexed.
    """
    sets = index.groupBy(key).agg(F.collect_set("trigram").alias("trigrams"))

    def holds(query: Query) -> Column:
        whole = F.lit(True)
        for part in query:
            one = F.lit(False)
            for strings in sorted(part, key=sorted):
                every = F.lit(True)
                for t in sorted(strings):
                    every = every & F.array_contains("trigrams", t)
                one = one | every
            whole = whole & one
        return whole

    kinds = F.array_compact(F.array(*[F.when(holds(q), F.lit(k)) for k, q in queries.items()]))
    return sets.select(key, kinds.alias("kinds")).filter(F.size("kinds") > 0)


#: Matches whose positions are summed up one after the other; longer lists are summed in runs of so many.
RUN = 256


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Spans of one rule as an array of ``(start, place, kind, stop)``, in code points.

    A text cut at the matches leaves the gaps between them; gap and match lengths add up to the positions. They are
    added up inside runs of ``RUN`` matches and then over the runs, since an array that grows by one element is copied
    every time: the work grows with the matches, not with their square.
    """
    pattern = F.lit(rule.regex)
    gaps = F.transform(F.split(text, rule.regex, -1), F.length)
    matches = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    sizes = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length) if rule.group else matches
    # The last gap, behind the last match, has no match.
    steps = F.filter(F.arrays_zip(gaps.alias("gap"), matches.alias("match"), sizes.alias("size")), lambda x: x["match"].isNotNull())
    none = F.array().cast("array<struct<start:int,stop:int>>")

    def step(state, x):
        start = state["at"] + x["gap"]
        stop = start + x["match"]
        span = F.struct(start.alias("start"), stop.alias("stop"))
        kept = F.when(x["size"] >= rule.least, F.array_append(state["found"], span)).otherwise(state["found"])
        return F.struct(stop.alias("at"), kept.alias("found"))

    def summed(run: Column) -> Column:
        return F.aggregate(run, F.struct(F.lit(0).alias("at"), none.alias("found")), step)

    def runs(all_steps: Column) -> Column:
        n = F.ceil(F.size(all_steps) / RUN).cast("int")
        cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: summed(F.slice(all_steps, i * RUN + 1, RUN)))
        return F.when(n > 0, cut).otherwise(F.array().cast("array<struct<at:int,found:array<struct<start:int,stop:int>>>>"))

    def after(ends: Column, x: Column) -> Column:
        return F.array_append(ends, F.element_at(ends, -1) + x["at"])

    def shifted(run: Column, by: Column) -> Column:
        return F.transform(
            run["found"],
            lambda x: F.struct(
                (x["start"] + by).alias("start"), F.lit(order).alias("place"), F.lit(rule.kind).alias("kind"), (x["stop"] + by).alias("stop")
            ),
        )

    def placed(found: Column) -> Column:
        before = F.aggregate(found, F.array(F.lit(0)), after)
        return _let(before, lambda starts: F.flatten(F.transform(found, lambda run, i: shifted(run, F.get(starts, i)))))

    return _let(steps, lambda all_steps: _let(runs(all_steps), placed))


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(
            F.array_sort(spans),
            lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string")),
        ),
        ",",
    )


def scan_secrets(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``secrets``: an array of ``(start, place, kind, stop)`` in order of start and rule.

    Rules that require trigrams run only on texts that the inverted index gives for them; rules without run on every
    text. Texts are indexed by a 64-bit hash of their content: equal texts share their postings, and should two
    different texts share a hash, both are candidates for what either has, and the rules decide. A null text has no
    spans, every row stays, and a column ``secrets`` that ``docs`` may have is replaced. Positions count code points,
    ends are exclusive.
    """
    queries = {r.kind: trigram_query(r.regex) for r in rules}
    indexed = {k: q for k, q in queries.items() if q}
    base = docs.drop("secrets")
    key, kinds, key2 = fresh(base, "text_key"), fresh(base, "scan_kinds"), fresh(base, "scan_key")
    keyed = base.withColumn(key, F.xxhash64(text))
    index = postings(keyed.select(key, F.col(text)), _trigrams(indexed), key, text)
    # Written first: where a text is in very many rows, adaptive execution then splits the rows of its key.
    chosen = written(candidates(index, indexed, key).select(F.col(key).alias(key2), F.col("kinds").alias(kinds)), "scan-kinds")
    rows = keyed.join(chosen, F.col(key) == F.col(key2), "left")
    body = F.coalesce(F.col(text), F.lit(""))
    empty = F.array().cast("array<struct<start:int,place:int,kind:string,stop:int>>")
    found = []
    for order, rule in enumerate(rules):
        here = F.array_contains(kinds, rule.kind) if rule.kind in indexed else F.lit(True)
        # A quick look for a long enough run saves cutting up texts that have none.
        look = rf"{rule.regex[:-1]}{{{rule.least},}}" if rule.regex.endswith("]+") and rule.regex.startswith("[") else rule.regex
        found.append(F.when(here & body.rlike(look), _spans(body, rule, order)).otherwise(empty))
    return rows.withColumn("secrets", F.array_sort(F.concat(*found))).select(*base.columns, "secrets")


def secret_digest(found: DataFrame, base: tuple[str, ...] = BASE) -> DataFrame:
    """Counts per base kind, the SHA-256 of the base spans and all spans as text."""

    def of_kind(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")

    own = F.filter("secrets", lambda x: x["kind"].isin(*base))
    return found.select(
        "doc_id",
        *[of_kind(k).alias(f"n_{k}") for k in base],
        F.sha2(_joined(own).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("secrets")).alias("spans"),
    )
