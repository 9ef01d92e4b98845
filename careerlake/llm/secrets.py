"""Secrets in texts, by one automaton of all rules.

A rule is a head followed by a run of bytes of one class, taken as far as it goes; runs shorter than the rule's least drop the match,
which still uses up its bytes. Matches of a kind are leftmost and don't overlap. Spans are of whole matches, in code points, the end
exclusive. Spans of different kinds may overlap; those with one start come by kind, as listed. A null text counts as empty and has no
secret; a very long one is scanned whole, in time and memory in proportion to its length; repeated rows stay; an empty table gives an
empty result; other columns are not read, but kept by redact_secrets.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careerlake.llm.automaton import Dfa, compiled, dead, parse, scan, turned
from careerlake.llm.common import by_text, table


class Rule(NamedTuple):
    kind: str
    head: str
    run: str
    least: int


BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=\\-]", 6),
    Rule("access", "AKIA", "[A-Z0-9]", 16),
    Rule("hex", "", "[0-9a-f]", 24),
)
#: What the method adds: well-known public forms of keys.
MORE = (
    Rule("hosting", "gh[opsur]_", "[A-Za-z0-9]", 30),
    Rule("chat", "xox[abprs]\\-", "[A-Za-z0-9\\-]", 10),
    Rule("maps", "AIza", "[A-Za-z0-9_\\-]", 30),
    Rule("payment", "sk_(live|test)_", "[A-Za-z0-9]", 16),
    Rule("signed", "eyJ[A-Za-z0-9_\\-]+\\.eyJ[A-Za-z0-9_\\-]+\\.", "[A-Za-z0-9_\\-]", 10),
    Rule("private", "\\-\\-\\-\\-\\-BEGIN ((RSA|EC|DSA|OPENSSH|ENCRYPTED) )?PRIVATE KEY\\-\\-\\-\\-", "\\-", 1),
)


class Scanner(NamedTuple):
    """The rules with their automaton, and of each rule the reversed one with its dead states and the bytes of its run."""

    rules: tuple[Rule, ...]
    forward: Dfa
    back: tuple[tuple[Dfa, frozenset[int]], ...]
    runs: tuple[frozenset[int], ...]
    seen: tuple[int, ...]  # length of the run at the first event
    steady: frozenset[int]  # accepting states of which only the first of several in a row tells something


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...] = BASE + MORE) -> Scanner:
    """A rule with a head is noticed at the first byte of its run; one without, when its run is long enough."""
    seen = tuple(1 if r.head else r.least for r in rules)
    trees = [parse(r.head + r.run + f"{{{n}}}") for r, n in zip(rules, seen)]
    back = [compiled([turned(t)], anchored=True) for t in trees]
    forward = compiled(trees, anchored=False)
    # a rule without a head accepts at each further byte of a run, which its first match takes whole
    steady = frozenset(forward.accepting + i for i, found in enumerate(forward.rules) if not any(rules[k].head for k in found))
    return Scanner(rules, forward, tuple((d, dead(d)) for d in back), tuple(parse(r.run)[1][0][1] for r in rules), seen, steady)


def start_of(back: Dfa, gone: frozenset[int], data: bytes, end: int, bound: int) -> int | None:
    """The smallest start, not below bound, of a match that the reversed automaton finds before end."""
    s, best, limit = 0, None, back.accepting * back.width
    for i in range(end - 1, bound - 1, -1):
        s = int(back.next[s + back.classes[data[i]]])
        if s >= limit:
            best = i
        elif s in gone:
            break
    return best


def code_points(data: bytes, places: set[int]) -> dict[int, int]:
    """Number of code points before each of the places (bytes at which one starts), counted on from place to place."""
    out, before, n = {}, 0, 0
    for i in sorted(places):
        n += len(data[before:i].decode())
        out[i], before = n, i
    return out


def spans(scan_with: Scanner, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Of each text, (start, number of the rule, end) in code points, in order."""
    data = [t.encode() for t in texts]
    out = []
    for text, b, events in zip(texts, data, scan(scan_with.forward, data, scan_with.steady)):
        found, past = [], [0] * len(scan_with.rules)
        for end, state in events:
            for k in scan_with.forward.rules[state - scan_with.forward.accepting]:
                if end - scan_with.seen[k] < past[k]:
                    continue
                start = start_of(*scan_with.back[k], b, end, past[k])
                if start is None:
                    continue
                to, run = end, scan_with.runs[k]
                while to < len(b) and b[to] in run:
                    to += 1
                past[k] = to
                if to - end + scan_with.seen[k] >= scan_with.rules[k].least:
                    found.append((start, k, to))
        if found and len(b) != len(text):
            at = code_points(b, {i for s, _, e in found for i in (s, e)})
            found = [(at[s], k, at[e]) for s, k, e in found]
        out.append(sorted(found))
    return out


SCHEMA = pa.schema([("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])
DDL = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """Counts, digest of the base spans, and all spans (kind:start:end) of each row."""
    use = scanner(rules)

    def digest(texts: list[str]) -> list[tuple]:
        rows = []
        for found in spans(use, texts):
            said = [(k, f"{rules[k].kind}:{s}:{e}") for s, k, e in found]
            base = ",".join(x for k, x in said if k < len(BASE))
            counts = [sum(k == i for k, _ in said) for i in range(len(BASE))]
            rows.append((*counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(x for _, x in said)))
        return rows

    return by_text(docs, SCHEMA, DDL, digest)


def redacted(text: str, found: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    """The text with each stretch of spans replaced by the kind of its first span."""
    out, at = [], 0
    for s, k, e in found:
        if s >= at:
            out += [text[at:s], f"[{rules[k].kind}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """docs with secrets replaced in text, and n_chars of the new text; a null text stays null."""
    use = scanner(rules)

    def clean(texts: list[str]) -> list[tuple[str]]:
        return [(redacted(t, f, rules),) for t, f in zip(texts, spans(use, texts))]

    rest = [c for c in docs.columns if c != "text"]
    row = docs.select(F.struct(*rest, F.col("text").isNull().alias("__none")).alias("__row"), "text")
    out = by_text(row, pa.schema([("__clean", pa.string())]), "__clean string", clean, ("__row",))
    text = F.when(~F.col("__row.__none"), F.col("__clean"))
    made = {"text": text, "n_chars": F.length(text).cast("long")}
    return out.select(*(made[c].alias(c) if c in made else F.col(f"__row.{c}").alias(c) for c in docs.columns))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op4_secret_scan": op4_secret_scan}
SQL: dict[str, str] = {}
