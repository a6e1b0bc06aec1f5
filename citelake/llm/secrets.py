"""Secret scans: base patterns, and formats learned by grammar inference.

For every kind of labelled credential a prefix tree with counts is built over character classes. States are
merged in breadth-first order with the most alike of the states kept so far, if their outgoing frequencies and the
frequencies of the lengths still to come agree (Hoeffding bound, recursively), which gives a probabilistic
automaton of the format: a value of fixed length keeps a state per place, one of varied length loops. Each
candidate, a run of 16 or more credential characters anywhere in a text (cut at ``=`` but for padding, without
dots and dashes at its ends), is scored: the largest log-likelihood of the whole value, its end included, over the
automata, against a character-bigram model of ordinary candidates. Candidates whose ratio reaches the margin
become spans of kind ``learned`` unless a base span covers a part of them.

Labels are the matches of the base patterns themselves; at most ``EXAMPLES`` of a kind and ``ORDINARY``
other candidates are fitted on, chosen by hash, each by its first ``FIT_CHARS`` characters. Every candidate of
every text is scored, whole.

Defined results: null and empty texts have no spans (``base_sha256`` is that of an empty string); a kind
without examples has no automaton, and without any nothing is learned; an empty table gives no rows; repeated rows
are scanned each; the time of a text follows its length, however many secrets it has. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelake.llm.store import Scratch

KINDS = ["assign", "access", "hex"]
ASSIGN = re.compile(
    r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are maximal, so this is [0-9a-f]+ of 32 and more
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.-]{16,}(?:={1,2}(?![A-Za-z0-9+/_.=-]))?")

EXAMPLES = 2_000  # of each kind
ORDINARY = 20_000
ALPHA = 0.05  # of the Hoeffding test
FIT_CHARS = 512  # of a word that is fitted on
MARGIN = 10.0  # nats of a whole candidate
BACK = 200  # occurrences of a character before its pairs outweigh single characters in the model of ordinary candidates
CHANCE = 0.3  # of that, the share in which all characters are alike
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-$"
LONGEST = 64  # characters of an example that the tree holds; what follows is scored by the frequencies of all states


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """(start, end) of the candidates that no base span touches; both lists are walked once."""
    free = iter(base)
    start, end = 0, 0  # of the joined base spans that end last
    ahead = next(free, None)
    for m in CANDIDATE.finditer(text):
        word = m[0]
        a = m.start() + len(word) - len(word.lstrip(".-"))
        b = m.start() + len(word.rstrip(".-"))
        if b - a < 16:
            continue
        while ahead is not None and ahead[0] < b:
            if ahead[0] > end:
                if end > a:
                    break
                start = ahead[0]
            end = max(end, ahead[2])
            ahead = next(free, None)
        if not (start < b and a < end):
            yield a, b


def _class(c: str) -> str:
    if c in "abcdef":
        return "a"
    if c.islower():
        return "z"
    if c.isupper():
        return "A"
    return "0" if c.isdigit() else c


#: Characters of a class, to spread its probability.
_WIDTH = {"a": 6, "z": 20, "A": 26, "0": 10}


class Automaton:
    """A probabilistic automaton merged from the prefix tree of examples."""

    def __init__(self, examples: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[Counter] = [Counter()]
        self.left: list[Counter] = [Counter()]  # characters still to come, by number
        self.open: set[int] = set()  # states in which an example was cut
        for word in sorted(examples):
            at, size = 0, min(len(word), LONGEST + 1)
            self.left[0][size] += 1
            for i, c in enumerate(map(_class, word[:LONGEST]), 1):
                self.count[at][c] += 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.count.append(Counter())
                    self.left.append(Counter())
                at = self.next[at][c]
                self.left[at][size - i] += 1
            if len(word) > LONGEST:
                self.open.add(at)
            else:
                self.count[at][""] += 1
        self.total = [sum(c.values()) for c in self.left]
        self._merge()

    def _gap(self, a: int, b: int) -> tuple[float, float]:
        """Largest difference of one frequency, and the sum of all differences."""
        n, m = self.total[a], self.total[b]
        gaps = [
            abs(one[c] / n - other[c] / m)
            for one, other in ((self.count[a], self.count[b]), (self.left[a], self.left[b]))
            for c in one.keys() | other.keys()
        ]
        return max(gaps), sum(gaps)

    def _differ(self, a: int, b: int) -> bool:
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (self.total[a] ** -0.5 + self.total[b] ** -0.5)
            if bound >= 1:  # nor can states behind them differ, which have fewer examples
                continue
            if self._gap(a, b)[0] > bound:
                return True
            pairs += [(self.next[a][c], self.next[b][c]) for c in self.next[a].keys() & self.next[b].keys() if self.next[a][c] != self.next[b][c]]
        return False

    def _fold(self, into: int, gone: int) -> None:
        pairs = [(into, gone)]
        while pairs:
            a, b = pairs.pop()
            self.count[a] += self.count[b]
            self.left[a] += self.left[b]
            self.total[a] += self.total[b]
            if b in self.open:
                self.open.add(a)
            for c, t in self.next[b].items():
                if c in self.next[a]:
                    pairs.append((self.next[a][c], t))
                else:
                    self.next[a][c] = t

    def _merge(self) -> None:
        kept = {0: None}
        fringe = deque((0, c) for c in sorted(self.next[0]))
        while fringe:
            parent, c = fringe.popleft()
            state = self.next[parent][c]
            if state in kept:
                continue
            for old in sorted(kept, key=lambda k: self._gap(k, state)[1]):
                if not self._differ(old, state):
                    self.next[parent][c] = old
                    self._fold(old, state)
                    break
            else:
                old = state
                kept[old] = None
            fringe += [(old, x) for x in sorted(self.next[old]) if self.next[old][x] not in kept]
        name = {s: i for i, s in enumerate(kept)}
        whole: Counter = Counter()
        for s in kept:
            whole += self.count[s]
        size = max(1, sum(whole.values()))
        self.anywhere = {c: math.log(n / size / _WIDTH.get(c, 1)) for c, n in whole.items()}
        self.cut = [s in self.open for s in kept]
        self.states = []
        for s in kept:
            size = sum(self.count[s].values())
            self.states.append(
                {c: (math.log(n / size / _WIDTH.get(c, 1)), name.get(self.next[s].get(c), -1)) for c, n in self.count[s].items()}
            )

    def score(self, classes: str, floor: float) -> float:
        """Log-likelihood of the whole value and its end; what was never seen costs ``floor`` and keeps the state."""
        at, total = 0, 0.0
        for c in classes:
            step = self.states[at].get(c)
            if step is not None:
                total += step[0] if step[0] > floor else floor
                at = step[1]
            else:
                total += self.anywhere.get(c, floor) if self.cut[at] else floor
        step = self.states[at].get("")
        if step is not None:
            return total + max(step[0], floor)
        return total + (self.anywhere.get("", floor) if self.cut[at] else floor)


class Scanner:
    """Automata of all kinds and the model of ordinary candidates."""

    FLOOR = -9.0

    def __init__(self, examples: dict[str, list[str]], ordinary: list[str], margin: float = MARGIN):
        self.margin = margin
        self.automata = [Automaton(examples[k]) for k in KINDS if examples.get(k)]
        pairs, single = Counter(), Counter()
        for word in ordinary:
            for a, b in zip("^" + word, word + "$"):
                pairs[a + b] += 1
                single[a] += 1
        # Pairs where there is evidence, else single characters, else all alike: a name of unseen pairs is no secret
        # for that alone, and a value that happens to be among the ordinary words is not known by heart.
        ends: Counter = Counter()
        for pair, n in pairs.items():
            ends[pair[1]] += n
        size = max(1, sum(ends.values()))
        self.other = {b: (1 - CHANCE) * ends[b] / size + CHANCE / len(SYMBOLS) for b in SYMBOLS}
        self.plain = {
            a + b: math.log((pairs[a + b] + BACK * self.other[b]) / (n + BACK)) for a, n in single.items() for b in SYMBOLS
        }
        self.other = {b: math.log(p) for b, p in self.other.items()}
        self.classes = str.maketrans({c: _class(c) for c in map(chr, range(33, 127))})

    def ratio(self, word: str) -> float:
        """Log-likelihood ratio of the whole word, format against ordinary."""
        if not self.automata:
            return -math.inf
        classes = word.translate(self.classes)
        best = max(a.score(classes, self.FLOOR) for a in self.automata)
        get, other = self.plain.get, self.other
        return best - sum(get(a + b) or other[b] for a, b in zip("^" + word, word + "$"))

    def spans(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        base = base_spans(text)
        learned = [(a, len(KINDS), b) for a, b in candidates(text, base) if self.ratio(text[a:b]) >= self.margin]
        return base, learned


def labelled(docs: DataFrame) -> DataFrame:
    """(kind, word): credentials found by the base patterns, and ordinary candidates (kind ``other``), distinct by batch."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[str, str]] = set()
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                spans = base_spans(text)
                for start, kind, end in spans:
                    word = text[start:end]
                    found.add((KINDS[kind], (ASSIGN.match(word)[2] if kind == 0 else word)[:FIT_CHARS]))
                found |= {("other", text[a:b][:FIT_CHARS]) for a, b in candidates(text, spans)}
            keys = sorted(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in keys], pa.string()), pa.array([w for _, w in keys], pa.string())], ["kind", "word"]
            )

    return docs.select("text").mapInArrow(find, "kind string, word string")


def fit(docs: DataFrame, margin: float = MARGIN) -> Scanner:
    """Automata from a bounded choice of labelled words: the first by hash, so it is the same each time.

    The texts are read once; the distinct words are stored, and dropped after the choice.
    """
    scratch = Scratch(docs.sparkSession)
    words = scratch.put(labelled(docs).distinct().withColumn("h", F.xxhash64("word")))
    many = {r.kind: r["count"] for r in words.groupBy("kind").count().collect()}
    examples: dict[str, list[str]] = {}
    for kind, most in [*((k, EXAMPLES) for k in KINDS), ("other", ORDINARY)]:
        n = many.get(kind, 0)
        part = words.where(F.col("kind") == kind)
        # The sort sees a range of hashes that holds few more words than are kept, whatever their number.
        share = (most + 10 * math.sqrt(most) + 100) / max(n, 1)
        few = part.where(F.col("h") < int(share * 2**64) - 2**63) if share < 1 else part
        first = _first(few, most)
        examples[kind] = first if len(first) == min(n, most) else _first(part, most)
    scratch.drop(words)
    return Scanner(examples, examples.pop("other"), margin)


def _first(words: DataFrame, most: int) -> list[str]:
    return [r.word for r in words.orderBy("h", "word").limit(most).select("word").collect()]


def _join(spans: list[tuple[int, int, int]]) -> str:
    names = [*KINDS, "learned"]
    return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """doc_id, counts of base spans, their digest and all spans. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                rows = [scanner.spans(t or "") for t in part.column(0).to_pylist()]
                counts = [Counter(k for _, k, _ in base) for base, _ in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(1),
                        *(pa.array([c[k] for c in counts], pa.int64()) for k in range(3)),
                        pa.array([hashlib.sha256(_join(base).encode()).hexdigest() for base, _ in rows]),
                        pa.array([_join(sorted(base + more)) for base, more in rows]),
                        pa.array([len(more) for _, more in rows], pa.int64()),
                    ],
                    ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_learned"],
                )

    return docs.select("text", "doc_id").mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_learned long"
    )


def find_secrets(docs: DataFrame, margin: float = MARGIN) -> DataFrame:
    return scan(docs, fit(docs, margin))
