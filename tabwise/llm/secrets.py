"""Secret scans through a trigram inverted index, in DataFrame functions only.

From each rule's pattern a Boolean trigram query is derived: the literal alternatives the pattern cannot match
without, as an OR of ANDs of trigrams. Postings of the trigrams that some rule asks for are built over whole texts,
intersected per alternative, and candidates are verified with the rule's regular expression. A rule without mandatory
trigrams (a run of hexadecimal digits) scans every text.

Spans come from the pieces between matches: splitting at the pattern and extracting all matches give the same
leftmost non-overlapping matches, and their lengths add up to positions in code points. Only lengths leave the row:
texts are neither shuffled nor copied, and a text of any number of secrets costs time in proportion to them.

Defined results: null text is empty and has no spans; rows that repeat id and text get the same result; an empty
table gives no rows.
"""

from __future__ import annotations

import re
import re._parser as patterns
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwise.session import cut_lineage

MAX_ALTERNATIVES = 64


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # leftmost non-overlapping matches
    group: int = 0  # group whose length counts
    least: int = 1  # shortest length that stands
    any_case: bool = False
    base: bool = True


# The three base kinds. Runs that must reach a length are asked for at that length at once: such a
# match is a maximal run, so shorter ones need not be found first.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", base=False),
    Rule("github", r"(ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36}", base=False),
    Rule("github_fine", r"github_pat_[A-Za-z0-9_]{60}", base=False),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20}", base=False),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,72}", base=False),
    Rule("slack_hook", r"hooks\.slack\.com/services/[A-Za-z0-9/]{20,60}", base=False),
    Rule("google_api", r"AIza[A-Za-z0-9_-]{35}", base=False),
    Rule("google_oauth", r"[0-9]{6,20}-[a-z0-9]{20,40}\.apps\.googleusercontent\.com", base=False),
    Rule("stripe", r"(sk|rk)_(live|test)_[A-Za-z0-9]{16,99}", base=False),
    Rule("npm", r"npm_[A-Za-z0-9]{36}", base=False),
    Rule("pypi", r"pypi-AgE[A-Za-z0-9_-]{50,200}", base=False),
    Rule("sendgrid", r"SG\.[A-Za-z0-9_-]{16,32}\.[A-Za-z0-9_-]{16,64}", base=False),
    Rule("mailgun", r"key-[0-9a-z]{32}", base=False),
    Rule("shopify", r"shp(at|ca|pa|ss)_[0-9a-fA-F]{32}", base=False),
    Rule("digitalocean", r"do[opr]_v1_[0-9a-f]{64}", base=False),
    Rule("square", r"sq0(atp|csp)-[A-Za-z0-9_-]{22,43}", base=False),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,400}\.eyJ[A-Za-z0-9_-]{10,800}\.[A-Za-z0-9_-]{10,400}", base=False),
    Rule("azure_storage", r"AccountKey=[A-Za-z0-9+/]{40,100}", base=False),
    Rule("basic_url", r"https?://[A-Za-z0-9_.-]{1,40}:[A-Za-z0-9_.!*-]{3,60}@", base=False),
    Rule("putty", r"PuTTY-User-Key-File-[23]", base=False),
    Rule("age", r"AGE-SECRET-KEY-1[0-9A-Z]{58}", base=False),
)
#: Candidate keys up to this many are sent to the texts (16 bytes and a few kinds each); more are joined by shuffle.
BROADCAST_KEYS = 500_000


def trigram_query(pattern: str) -> list[set[str]]:
    """Alternatives, each a set of lower-case trigrams that all must occur; empty when the pattern forces none."""
    clauses: list[list[set[str]]] = []  # AND of ORs of ANDs

    def flush(strings: set[str]) -> None:
        grams = [{s[i : i + 3].lower() for i in range(len(s) - 2)} for s in strings]
        if grams and all(grams):
            clauses.append(grams)

    def walk(parsed, strings: set[str]) -> set[str]:
        for op, arg in parsed:
            name, ways = str(op), None
            if name == "LITERAL":
                ways = {chr(arg)}
            elif name == "SUBPATTERN":
                ways = fixed(arg[3])
            elif name in ("BRANCH", "IN"):
                ways = fixed([(op, arg)])
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] == 1 and (inner := fixed(arg[2])) is not None:
                ways = inner | {""} if arg[0] == 0 else inner
            elif name in ("ASSERT", "ASSERT_NOT", "AT"):
                continue
            if ways is None or len(ways) * len(strings) > MAX_ALTERNATIVES:
                flush(strings)
                strings = {""}
            else:
                strings = {a + b for a, b in product(strings, ways)}
        return strings

    def fixed(parsed) -> set[str] | None:
        """All strings a part can match, None if they are many."""
        out = {""}
        for op, arg in parsed:
            name = str(op)
            if name == "LITERAL":
                ways = {chr(arg)}
            elif name == "BRANCH":
                parts = [fixed(x) for x in arg[1]]
                ways = None if None in parts else set().union(*parts)
            elif name == "IN":
                ways = {chr(x) for kind, x in arg} if all(str(kind) == "LITERAL" for kind, _ in arg) else None
            elif name == "SUBPATTERN":
                ways = fixed(arg[3])
            elif name == "MAX_REPEAT" and arg[1] == 1:
                ways = fixed(arg[2])
                ways = ways | {""} if ways is not None and arg[0] == 0 else ways
            else:
                ways = None
            if ways is None or len(out) * len(ways) > MAX_ALTERNATIVES:
                return None
            out = {a + b for a, b in product(out, ways)}
        return out

    flush(walk(patterns.parse(pattern), {""}))
    if not clauses:
        return []
    best = min(clauses, key=lambda c: (len(c), -min(map(len, c))))  # one clause is mandatory by itself; the most selective is used
    return list(best)


def _key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def postings(docs: DataFrame, trigrams: list[str], id_col: str, text_col: str) -> DataFrame:
    """(gram, key): the texts that hold each of the given trigrams, in any case."""
    low = F.lower(F.col(text_col))
    rows = docs.select(_key(id_col, text_col).alias("key"), low.alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return rows.select("key", F.explode(held).alias("gram"))


def candidates(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, kinds): texts that satisfy the trigram query of a rule, with the kinds to verify."""
    spark = docs.sparkSession
    branches = [(r.kind, f"{r.kind}{i}", g, len(alt)) for r in rules for i, alt in enumerate(trigram_query(r.pattern)) for g in sorted(alt)]
    if not branches:
        return spark.createDataFrame([], "key bigint, kinds array<string>")
    asked = spark.createDataFrame(branches, "kind string, branch string, gram string, need int")  # as large as the rules
    posted = postings(docs, sorted({b[2] for b in branches}), id_col, text_col)
    met = posted.join(F.broadcast(asked), "gram").groupBy("key", "kind", "branch", "need").agg(F.count_distinct("gram").alias("n")).filter("n = need")
    return met.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


_PIECE = "array<struct<ord:int,pos:int,gap:int,hit:int,part:int>>"


def rule_pieces(rule: Rule, text: Column, order: int) -> Column:
    """Lengths of the stretches before a rule's matches, of the matches and of the parts that count, in order."""
    pattern = ("(?i)" if rule.any_case else "") + rule.pattern
    lengths = [F.transform(a, lambda x: F.length(x)) for a in (F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)))]
    zipped = F.arrays_zip(*[a.alias(n) for a, n in zip(lengths, ("gap", "hit", "part"))])
    pieces = F.transform(zipped, lambda x, i: F.struct(F.lit(order).alias("ord"), i.alias("pos"), x["gap"].alias("gap"), x["hit"].alias("hit"), x["part"].alias("part")))
    return F.when(text.rlike(pattern), pieces).otherwise(F.array().cast(_PIECE))


def find_secrets(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, __spans): the spans of each document as (start, ord, stop, kind), by start and rule order."""
    indexed = {r.kind for r in rules if trigram_query(r.pattern)}
    rows = docs.select(id_col, _key(id_col, text_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    keys = cut_lineage(candidates(docs, rules, id_col, text_col))
    joined = rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, "key", "left")
    none = F.array().cast(_PIECE)
    parts = [F.when(F.array_contains("kinds", r.kind), rule_pieces(r, F.col("t"), i)).otherwise(none) if r.kind in indexed else rule_pieces(r, F.col("t"), i) for i, r in enumerate(rules)]
    mark = F.array(F.struct(*[F.lit(v).cast("int").alias(n) for n, v in (("ord", -1), ("pos", 0), ("gap", 0), ("hit", None), ("part", None))]))
    # one row per document and one per match: lengths only
    numbered = joined.withColumn("rid", F.monotonically_increasing_id())
    lone = cut_lineage(numbered.select("rid", id_col, F.inline(F.concat(mark, *parts))))
    upto = F.sum(F.col("gap") + F.coalesce("hit", F.lit(0))).over(Window.partitionBy("rid", "ord").orderBy("pos"))
    placed = lone.repartition("rid").withColumn("stop", upto.cast("int"))
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.greatest(F.col("ord"), F.lit(0)) + 1)
    kind = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.greatest(F.col("ord"), F.lit(0)) + 1)
    one = F.struct((F.col("stop") - F.col("hit")).alias("start"), "ord", "stop", kind.alias("kind"))
    stands = (F.col("ord") >= 0) & F.col("hit").isNotNull() & (F.col("part") >= least)
    return placed.groupBy("rid").agg(F.first(id_col).alias(id_col), F.array_sort(F.collect_list(F.when(stands, one))).alias("__spans")).select(id_col, "__spans")


def report(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_<kind> of the base rules, base_sha256, spans)."""
    found = find_secrets(docs, rules, id_col, text_col)
    base = [r.kind for r in rules if r.base]

    def line(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    def of_base(s):
        return s["kind"].isin(base)

    def number(kind):
        return F.size(F.filter("__spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [number(k) for k in base]
    return found.select(id_col, *counts, F.sha2(line(F.filter("__spans", of_base)), 256).alias("base_sha256"), line(F.col("__spans")).alias("spans"))


def check_pattern(rule: Rule) -> re.Pattern:
    """The rule as a Python pattern, for tests."""
    return re.compile(rule.pattern, re.I | re.A if rule.any_case else 0)
