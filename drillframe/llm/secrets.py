"""Secret scan over a trigram inverted index, in DataFrame functions only.

1. Each rule's regular expression is parsed once on the driver into a Boolean query: an OR of clauses, each an AND of
   lower-cased trigrams that every match must contain. A rule from which no trigram follows scans all texts.
2. The index holds a posting (trigram, row key) for every text that contains a trigram of the rules' vocabulary.
3. Postings meet the clauses and are intersected by counting: a clause whose trigrams are all posted makes its rule a
   candidate for the row.
4. Candidates come to the texts, which stay in place, and are verified with the regular expression itself, which also
   gives the spans, in time that is linear in the text, whether a rule matches or fails there, and nearly so in the
   number of matches.

Edge cases: a null text counts as empty; an empty text has no spans, and the digest of no spans is that of the empty
string; rows with equal ids or texts are scanned alike and each keeps its row (the key of a row is a hash of id and
text; a clash only adds a candidate, which is then verified); an empty table gives an empty result; further columns
of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

try:  # Python's own parser of regular expressions, under its name since 3.11
    from re import _constants as sre, _parser as sre_parse
except ImportError:  # pragma: no cover
    import sre_constants as sre
    import sre_parse

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import meet, plain_text


@dataclass(frozen=True)
class Rule:
    """kind: name in spans. pattern: for Java, Python and SQL alike. group, least: the group that must have so many
    characters. linear: where the pattern would try each beginning anew to the end of a run, another for Java and Python
    with the same matches, each behind a group 1 that doesn't belong to it."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    linear: str = ""


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYWORD = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_")) + "?" + either_case("key")

_TOKEN = "[A-Za-z0-9_-]"

#: The contract's three kinds, then those that the method adds. Runs of one class are maximal, so that a lower bound on
#: their length in the pattern finds the same matches as a later check; for `assign` the check must come afterwards.
BASE_RULES = (
    Rule("assign", rf"""({_KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
ADDED_RULES = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    # A run is judged once, from the first eyJ in it: where that fails, a later one, with less behind it, fails as well.
    Rule("jwt", rf"eyJ{_TOKEN}{{10,}}\.eyJ{_TOKEN}{{10,}}\.{_TOKEN}{{10,}}", linear=rf"(?<!{_TOKEN})((?>{_TOKEN}*?(?=eyJ)))eyJ{_TOKEN}{{10,}}+\.eyJ{_TOKEN}{{10,}}+\.{_TOKEN}{{10,}}+"),
    Rule("hexupper", r"[0-9A-F]{40,}"),
)
RULES = BASE_RULES + ADDED_RULES

#: Most alternatives followed at once; an element that would need more counts as unknown text.
MAX_CLAUSES = 64
#: Most strings followed through one part of a pattern; beyond, the part counts as unknown.
MAX_STRINGS = 16


def _strings(node) -> list[str] | None:
    """All lower-cased strings that a single pattern element can match, or None if there are many."""
    op, arg = node
    if op is sre.LITERAL:
        return [chr(arg).lower()]
    if op is sre.IN and all(k is sre.LITERAL for k, _ in arg):
        found = sorted({chr(c).lower() for _, c in arg})
        return found if len(found) <= MAX_STRINGS else None
    return None


def _sequences(parsed) -> list[list[str | None]]:
    """The pattern's alternatives, each a list of known strings with None where text is unknown."""
    done: list[list[str | None]] = [[]]
    for node in parsed:
        op, arg = node
        if op is sre.SUBPATTERN:
            options = _sequences(arg[-1])
        elif op is sre.BRANCH:
            options = [s for branch in arg[1] for s in _sequences(branch)]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, body = arg
            inner = _sequences(body)
            if high == 1 and low == 0:
                options = [[], *inner]
            elif len(inner) == 1 and None not in inner[0] and low >= 1:
                options = [inner[0] * min(low, 4) + ([None] if high != low or low > 4 else [])]
            else:
                options = [[None]]
        elif op is sre.AT:
            options = [[]]
        else:
            options = [[s] for s in _strings(node) or [None]]
        if len(done) * len(options) > MAX_CLAUSES:
            options = [[None]]
        done = [a + b for a, b in product(done, options)]
    return done


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Clauses of lower-cased trigrams, one of which any match must hold wholly; None if some match needs no trigram."""
    clauses = set()
    for sequence in _sequences(sre_parse.parse(pattern)):
        known, grams = "", set()
        for part in [*sequence, None]:
            if part is None:
                grams |= {known[i : i + 3] for i in range(len(known) - 2)}
                known = ""
            else:
                known += part
        if not grams:
            return None
        clauses.add(frozenset(grams))
    return sorted((c for c in clauses if not any(d < c for d in clauses)), key=sorted)


def queries_of(rules=RULES) -> dict[str, list[frozenset[str]] | None]:
    return {r.kind: trigram_query(r.pattern) for r in rules}


def keyed(docs: DataFrame) -> DataFrame:
    """rest (all columns but text, packed away so that no name can clash), text and row_key."""
    rest = F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("rest")
    return docs.select(rest, plain_text().alias("text")).withColumn("row_key", F.xxhash64("rest.doc_id", "text"))


def build_index(keyed_docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Postings (trigram, row_key). The vocabulary is that of the rules: its size doesn't depend on the corpus."""
    held = keyed_docs.select("row_key", F.lower("text").alias("low"))
    grams = F.array(*[F.when(F.col("low").contains(g), F.lit(g)) for g in vocabulary])
    return held.select("row_key", F.explode(F.array_compact(grams)).alias("trigram"))


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """(row_key, kinds): the rules that have a clause with all its trigrams among the row's postings."""
    spark = index.sparkSession
    rows = [(kind, n, gram, len(clause)) for kind, query in queries_of(rules).items() if query for n, clause in enumerate(query) for gram in sorted(clause)]
    clauses = spark.createDataFrame(rows, "kind string, clause int, trigram string, needed int")
    met = index.join(F.broadcast(clauses), "trigram").groupBy("row_key", "kind", "clause", "needed").agg(F.count_distinct("trigram").alias("found"))
    return met.where("found = needed").groupBy("row_key").agg(F.collect_set("kind").alias("kinds"))


def _no_spans() -> Column:
    return F.array().cast("array<struct<at:int,to:int,kind:string>>")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once: what stands in a lambda but isn't its variable is computed anew each time."""
    return F.transform(F.array(value), then)[0]


def _running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """Running sums or maxima of an array, by doubling distances: its size times the logarithm of that, not its square.

    merge must take a null for what lies before the first value.
    """
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))
    back = lambda k: F.call_function("shiftleft", F.lit(1), k)
    return F.aggregate(rounds, values, lambda acc, k: F.transform(acc, lambda x, i: merge(x, F.get(acc, i - back(k)))))


def _matches(text: Column, rule: Rule, size: Callable[[Column], Column] = F.length) -> Column:
    """array<struct<at, to, kind>> of the rule's matches, in code points, or in bytes if size is octet_length.

    split() gives the text between the matches and regexp_extract_all() the matches: their sizes add up to positions.
    """
    pattern = rule.linear or rule.pattern
    found = lambda group: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    whole = F.zip_with(found(0), found(1), lambda m, lead: F.struct(m.alias("m"), size(lead).alias("lead"))) if rule.linear else F.transform(found(0), lambda m: F.struct(m.alias("m"), F.lit(0).alias("lead")))
    tested = F.transform(found(rule.group), F.length) if rule.group else F.lit(None).cast("array<int>")

    def placed(parts: Column) -> Column:
        sizes = F.zip_with(parts["gaps"], parts["whole"], lambda g, x: F.struct((size(g) + F.coalesce(size(x["m"]), F.lit(0))).alias("step"), (size(x["m"]) - x["lead"]).alias("own")))
        return _let(F.filter(sizes, lambda x: x["own"].isNotNull()), lambda xs: with_ends(parts, xs))

    def with_ends(parts: Column, xs: Column) -> Column:
        ends = _let(F.transform(xs, lambda x: x["step"]), lambda steps: _running(steps, lambda a, b: a + F.coalesce(b, F.lit(0))))
        enough = lambda k: F.get(parts["tested"], k) >= rule.least if rule.group else F.lit(True)
        span = lambda x, k, es: F.struct((F.get(es, k) - x["own"]).alias("at"), F.get(es, k).alias("to"), F.when(enough(k), F.lit(rule.kind)).alias("kind"))
        return F.filter(_let(ends, lambda es: F.transform(xs, lambda x, k: span(x, k, es))), lambda x: x["kind"].isNotNull())

    parts = F.struct(whole.alias("whole"), tested.alias("tested"), F.split(text, pattern, -1).alias("gaps"))
    return F.when(text.rlike(pattern), _let(parts, placed)).otherwise(_no_spans())


def scan(docs: DataFrame, rules=RULES, size: Callable[[Column], Column] = F.length) -> DataFrame:
    """rest and text of each row, and the spans (at, to, kind) of each rule in a column of its kind's name."""
    queries = queries_of(rules)
    vocabulary = sorted({g for q in queries.values() if q for c in q for g in c})
    rows = keyed(docs)
    flagged = meet(rows, candidates(build_index(rows, vocabulary), rules), ["row_key"])

    def spans(rule: Rule) -> Column:
        if queries[rule.kind] is None:
            return _matches(F.col("text"), rule, size)
        return F.when(F.array_contains("kinds", rule.kind), _matches(F.col("text"), rule, size)).otherwise(_no_spans())

    return flagged.select("rest", "text", *[spans(r).alias(r.kind) for r in rules])


def spans_text(kinds: list[str]) -> Column:
    """kind:start:end by start, then by the kinds' order, comma-joined."""
    rank = {k: i for i, k in enumerate(kinds)}

    def ranked(kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(x["at"].alias("at"), F.lit(rank[kind]).alias("rank"), x["to"].alias("to"), x["kind"].alias("kind")))

    order = F.concat(*[ranked(k) for k in kinds])
    return F.array_join(F.transform(F.sort_array(order), lambda x: F.concat_ws(":", x["kind"], x["at"].cast("string"), x["to"].cast("string"))), ",")


def secret_scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """The contract's columns, one row per document."""
    base, every = [r.kind for r in BASE_RULES], [r.kind for r in rules]
    out = scan(docs.select("doc_id", "text"), rules)
    out = out.select("rest.doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in base], spans_text(base).alias("base_spans"), spans_text(every).alias("spans"))
    return out.select("doc_id", *[f"n_{k}" for k in base], F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def redact(docs: DataFrame, rules=RULES, mark: str = "[secret]") -> DataFrame:
    """docs with each span replaced by the mark, spans that overlap as one, and n_chars counted anew where it exists.

    Positions are in bytes here: of bytes, a piece is cut out without counting from the text's beginning.
    """
    found = scan(docs, rules, F.octet_length).withColumn("spans", F.sort_array(F.concat(*[r.kind for r in rules])))
    piece = lambda data, at, to: F.substring(data, at + 1, to - at).cast("string")

    def kept(x: Column) -> Column:
        """The text before each span that doesn't lie in earlier ones, and the text after all."""
        before = lambda k: F.coalesce(F.get(x["reach"], k - 1), F.lit(0))
        gaps = F.transform(x["spans"], lambda s, k: F.when(s["at"] >= before(k), piece(x["data"], before(k), s["at"])))
        return F.concat(F.array_compact(gaps), F.array(piece(x["data"], F.element_at(x["reach"], -1), F.octet_length(x["data"]))))

    reach = _let(F.transform("spans", lambda s: s["to"]), lambda ends: _running(ends, F.greatest))
    text = F.array_join(_let(F.struct("spans", reach.alias("reach"), F.col("text").cast("binary").alias("data")), kept), mark)
    found = found.withColumn("text", F.when(F.size("spans") == 0, F.col("text")).otherwise(text))
    own = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return found.select(*[own.get(c, F.col("rest")[c] if c != "text" else None).alias(c) for c in docs.columns])


def oracle(rules=RULES) -> str:
    """The same in DuckDB's SQL, from the text between the matches."""
    def one(rule: Rule) -> str:
        pattern = "'" + rule.pattern.replace("'", "''") + "'"
        return f"""
        SELECT rid, '{rule.kind}' AS kind, {[r.kind for r in rules].index(rule.kind)} AS rank,
          (list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0))::BIGINT AS pos,
          length(hits[k])::BIGINT AS n
        FROM (SELECT rid, hits, tested, gaps, unnest(range(1, len(hits) + 1)) AS k FROM (
          SELECT rid, regexp_extract_all(text, {pattern}) AS hits, regexp_extract_all(text, {pattern}, {rule.group}) AS tested,
            regexp_split_to_array(text, {pattern}) AS gaps FROM d WHERE regexp_matches(text, {pattern})))
        WHERE length(tested[k]) >= {rule.least}"""

    base = ", ".join(f"'{r.kind}'" for r in BASE_RULES)
    listed = "string_agg(kind || ':' || pos || ':' || (pos + n), ',' ORDER BY pos, rank)"
    return f"""
    WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents),
    s AS ({" UNION ALL ".join(one(r) for r in rules)}),
    g AS (SELECT rid, {", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)},
      {listed} FILTER (kind IN ({base})) AS base_spans, {listed} AS spans FROM s GROUP BY rid)
    SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in BASE_RULES)},
      sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN g USING (rid)
    """
