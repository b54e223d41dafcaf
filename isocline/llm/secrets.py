"""Secret scans: fixed patterns, and probabilistic automata inferred from the credentials that these label.

A first pass over the texts finds the base matches, which are the labelled credentials. An automaton is inferred for each
kind: a prefix tree of the credentials' symbols whose compatible states are merged (Hoeffding bounds on the frequencies of
symbols, ends and letters). A symbol is the smallest class of letters that holds the whole piece of a string that a letter stands in,
so that credentials of one format share a path, and lengths and fixed parts stay states of their own. All strings outside base
spans give the automaton of ordinary strings. Trees grow where the strings are, and are summed by path. A second pass scores every string outside the base spans: it is a
further span if an automaton finds it as likely as the kind's own credentials are, and if it is likelier a credential than an
ordinary string, credentials being as rare as the labelled ones are among all strings.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import handing_back, key_field, slices, staged

# The patterns of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "format")
#: A candidate is a run of credential letters, as long as an assigned credential at least, or a part of one between marks.
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
SHORTEST = 6
#: What a worker holds at once, however much there is: rows of a prefix tree, and different strings of a partition with their letters.
TREE_ROWS, HELD, HELD_LETTERS = 100_000, 100_000, 8 << 20
#: Share of a kind's held-out credentials that may be less likely than the bar, and nats a letter that are allowed below it.
STRANGE, MARGIN = 0.02, 0.1
#: Share of a kind's held-out credentials that are less likely than what the first ordinary automaton is kept from.
SEEDS = 0.25
_CUES = ("passw", "secret", "token", "api")
# The classes of letters, smallest first.
CLASSES = (
    ("0", "0123456789"),
    ("h", "0123456789abcdef"),
    ("H", "0123456789ABCDEF"),
    ("l", "abcdefghijklmnopqrstuvwxyz"),
    ("U", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("x", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("X", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("a", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("n", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
)
_LETTERS = {name: len(letters) for name, letters in CLASSES}
_HOLDS = [(name, re.compile(f"[{letters}]+").fullmatch) for name, letters in CLASSES]
_PIECE = re.compile(r"[A-Za-z0-9]+|[^A-Za-z0-9]")
_PART, _MARKS = re.compile(r"[A-Za-z0-9+_-]+"), "+/_.=-"
#: Symbols that may follow, the end included; what a state has never seen counts as this many sightings of all of them.
_FOLLOW, _UNSEEN = len(CLASSES) + 7, 0.5


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, sorted."""
    found = []
    low = text.lower()
    if any(c in low for c in _CUES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def symbols(text: str) -> str:
    """A string's symbols, one for each letter; marks stand for themselves."""
    out = []
    for piece in _PIECE.findall(text):
        name = next((name for name, holds in _HOLDS if holds(piece)), piece)
        out.append(name * len(piece))
    return "".join(out)


Tree = dict[tuple[int, str, str], int]


def _state(before: int, c: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{before}{c}".encode(), digest_size=8).digest(), "little", signed=True)


def grown(strings: Iterable[tuple[str, int]]) -> Iterator[Tree]:
    """Parts of the prefix tree of strings' symbols, for strings with the number of times that each was seen.

    (state, symbol, letter): how many strings go on from a state by a symbol, which stands for the letter. (state, symbol, ""):
    how many end behind that. A state is a digest of its path, 0 the root; parts of any workers add up.
    """
    rows, states = {}, {}
    for string, n in strings:
        before, last, at = 0, "", 0
        for c, letter in zip(symbols(string), string, strict=True):
            if len(rows) >= TREE_ROWS:
                yield rows
                rows, states = {}, {}
            rows[at, c, letter] = rows.get((at, c, letter), 0) + n
            before, last = at, c
            if (at := states.get((before, c), 0)) == 0:
                at = states[before, c] = _state(before, c)
        rows[before, last, ""] = rows.get((before, last, ""), 0) + n
    yield rows


def added(parts: Iterable[Tree], sign: int = 1, to: Tree | None = None) -> Tree:
    """The sum of trees, or what is left of one."""
    out = dict(to or {})
    for part in parts:
        for k, n in part.items():
            out[k] = out.get(k, 0) + sign * n
    return {k: n for k, n in out.items() if n}


class Automaton:
    """A probabilistic deterministic automaton over symbols and their letters, by state merging (Alergia).

    Strings come with the number of times that each was seen, or as their tree. States are numbered by the order of symbols.
    """

    def __init__(self, strings: Iterable[tuple[str, int]] = (), alpha: float = 0.05, tree: Tree | None = None):
        self.next: list[dict[str, int]] = [{}]
        self.count, self.ends = [0], [0]
        self.seen: list[dict[str, int]] = [{}]
        self.letters: list[dict[str, int]] = [{}]
        below: dict[int, dict[str, dict[str, int]]] = {}
        for (state, c, letter), n in (added(grown(strings)) if tree is None else tree).items():
            below.setdefault(state, {}).setdefault(c, {})[letter] = n
        self.ends[0] = self.count[0] = below.get(0, {}).pop("", {}).get("", 0)
        todo = [(0, 0)]
        while todo:
            at, state = todo.pop()
            for c, told in sorted(below.pop(state, {}).items()):
                ends = told.pop("", 0)
                n = sum(told.values())
                self.next[at][c], self.seen[at][c] = len(self.next), n
                for letter, m in sorted(told.items()):
                    self.letters[at][letter] = self.letters[at].get(letter, 0) + m
                todo.append((len(self.next), _state(state, c)))
                self.next.append({})
                self.count.append(n)
                self.ends.append(ends)
                self.seen.append({})
                self.letters.append({})
        self.count[0] += sum(self.seen[0].values())
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()
        self.steps: dict[tuple[int, str, str], tuple[float, int]] = {}
        # Where a state has never seen a symbol, the string goes on in a state of all sightings.
        self.every_seen, self.every_end, self.every_count = Counter(), 0, 0
        self.every_letter: Counter = Counter()
        for s in self.states:
            self.every_seen.update(self.seen[s])
            self.every_letter.update(self.letters[s])
            self.every_end += self.ends[s]
            self.every_count += self.count[s]

    def _differ(self, x: int, n: int, y: int, m: int) -> bool:
        return n > 0 and m > 0 and abs(x / n - y / m) > self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _alike(self, a: int, b: int) -> bool:
        n, m = self.count[a], self.count[b]
        if n and m and self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m)) >= 1:
            return True
        if self._differ(self.ends[a], n, self.ends[b], m):
            return False
        for told in (self.seen, self.letters):
            x, y = told[a], told[b]
            if any(self._differ(x.get(c, 0), n, y.get(c, 0), m) for c in x.keys() | y.keys()):
                return False
        return True

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if not self._alike(a, b):
                return False
            todo += [(self.next[a][c], self.next[b][c]) for c in self.next[a].keys() & self.next[b].keys()]
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below b to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.count[a] += self.count[b]
            self.ends[a] += self.ends[b]
            for told in (self.seen, self.letters):
                for c, n in told[b].items():
                    told[a][c] = told[a].get(c, 0) + n
            for c, t in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], t))
                else:
                    self.next[a][c] = t

    def _merge(self) -> None:
        """Red states are kept, blue ones follow them; the blue state of most evidence is merged or kept first."""
        red, reds = [0], {0}
        blue = [(-self.count[t], t, 0, c) for c, t in self.next[0].items()]
        while blue:
            blue.sort(reverse=True)
            _, state, parent, c = blue.pop()
            for r in red:
                if self._compatible(r, state):
                    self.next[parent][c] = r
                    self._fold(r, state)
                    break
            else:
                red.append(state)
                reds.add(state)
            blue = [(-self.count[t], t, r, k) for r in red for k, t in self.next[r].items() if t not in reds]
        number = {state: i for i, state in enumerate(red)}
        self.next = [{c: number[t] for c, t in self.next[r].items()} for r in red]
        self.count, self.ends, self.seen, self.letters = ([told[r] for r in red] for told in (self.count, self.ends, self.seen, self.letters))
        self.states = list(range(len(red)))

    def _step(self, at: int, c: str, letter: str) -> tuple[float, int]:
        """The log probability of a letter in a state, and the state that follows."""
        if at >= 0:
            seen, letters, n = self.seen[at], self.letters[at], self.count[at]
        else:
            seen, letters, n = self.every_seen, self.every_letter, self.every_count
        p = (seen.get(c, 0) + _UNSEEN / _FOLLOW) / (n + _UNSEEN)
        if c in _LETTERS:  # the letter among the class's, as often as the state saw it
            p *= (letters.get(letter, 0) + 1.0) / (n + _LETTERS[c])
        return math.log(p), self.next[at].get(c, -1) if at >= 0 else -1

    def likelihood(self, text: str, coded: str | None = None, least: float = -math.inf) -> float:
        """The log probability of a string, its end included; minus infinity if that is below least."""
        at, total, steps = 0, 0.0, self.steps
        for c, letter in zip(coded or symbols(text), text, strict=True):
            key = (at, c, letter)
            if (step := steps.get(key)) is None:
                step = steps[key] = self._step(at, c, letter)
            total += step[0]
            if total < least:
                return -math.inf
            at = step[1]
        ends, n = (self.ends[at], self.count[at]) if at >= 0 else (self.every_end, self.every_count)
        total += math.log((ends + _UNSEEN / _FOLLOW) / (n + _UNSEEN))
        return total if total >= least else -math.inf

    def without(self, text: str, coded: str) -> float:
        """The log probability of a string that the automaton was trained on once, had it not been."""
        at, total = 0, 0.0
        for c, letter in zip(coded, text, strict=True):
            n = self.count[at] - 1
            total += math.log((max(0, self.seen[at][c] - 1) + _UNSEEN / _FOLLOW) / (n + _UNSEEN))
            if c in _LETTERS:
                total += math.log((max(0, self.letters[at][letter] - 1) + 1.0) / (n + _LETTERS[c]))
            at = self.next[at][c]
        return total + math.log((max(0, self.ends[at] - 1) + _UNSEEN / _FOLLOW) / (self.count[at] - 1 + _UNSEEN))


class FormatModel:
    """The automata of the kinds with their bars, and the automaton of ordinary strings.

    A kind's bar is the low quantile of its credentials' mean log likelihoods a letter, each by an automaton of other
    folds; a lone credential by its own as if that had seen none. strings: what the texts hold outside base spans, with the number of texts that
    hold each. Strings of one text may be credentials without a cue: those as likely as most of the labelled ones
    don't train the first ordinary automaton, and those that a model accepts don't train the next one. learned() fits the
    same model on tables of any size.
    """

    FOLDS, ROUNDS = 5, 5

    def __init__(self, credentials: dict[int, list[str]], strings: dict[str, int], runs: int = 0):
        self.kinds: list[tuple[Automaton, float]] = []
        self.known: dict[str, list[tuple[int, int]]] = {}
        self.ordinary: Automaton | None = None
        labelled, better = 0, []
        for words in credentials.values():
            if not words:
                continue
            labelled += len(words)
            folds = min(self.FOLDS, len(words))
            held = []
            for k in range(folds):
                automaton = Automaton((w, 1) for i, w in enumerate(words) if folds == 1 or i % folds != k)
                told = automaton.likelihood if folds > 1 else automaton.without
                held += [told(w, symbols(w)) / (len(w) + 1) for w in words[k::folds]]
            self.kinds.append((Automaton((w, 1) for w in words), float(np.quantile(held, STRANGE)) - MARGIN))
            better.append(float(np.quantile(held, SEEDS)) - self.kinds[-1][1])
        self.prior = math.log(labelled / (labelled + max(runs, sum(strings.values()), 1))) if labelled else -math.inf
        if not self.kinds or not strings:
            return
        typical = {w: first for w, n in strings.items() if n == 1 and (first := self.typical(w, better)) is not None}
        for _ in range(self.ROUNDS):
            self.ordinary = Automaton((w, n) for w, n in strings.items() if not typical.get(w))
            again = {w: self.judged(w, taken) for w, taken in typical.items()}
            if again == typical:
                break
            typical = again

    def typical(self, text: str, better: list[float]) -> bool | None:
        """Whether a lone string is so like credentials that it doesn't train the first ordinary automaton; None if no bar is reached."""
        coded = symbols(text)
        if self._best(text, coded) == -math.inf:
            return None
        return any(a.likelihood(text, coded, (bar + more) * (len(text) + 1)) > -math.inf for (a, bar), more in zip(self.kinds, better, strict=True))

    def judged(self, text: str, taken: bool) -> bool:
        """Whether a typical string is likelier a credential than an ordinary one, which trained that automaton unless it was taken."""
        coded = symbols(text)
        plain = self.ordinary.likelihood(text, coded) if taken else self.ordinary.without(text, coded)
        return self._best(text, coded) + self.prior > plain

    def _best(self, text: str, coded: str) -> float:
        """The largest log likelihood by an automaton whose bar the string reaches."""
        return max(automaton.likelihood(text, coded, bar * (len(text) + 1)) for automaton, bar in self.kinds)

    def _excess(self, text: str, coded: str) -> float | None:
        """By how much a letter an accepted string is above its bar."""
        best = self._best(text, coded) if self.kinds else -math.inf
        if best == -math.inf or self.ordinary is not None and best + self.prior <= self.ordinary.likelihood(text, coded):
            return None
        return max(x / (len(text) + 1) - bar for automaton, bar in self.kinds if (x := automaton.likelihood(text, coded)) > -math.inf)

    def accepts(self, text: str) -> bool:
        """Whether a string is as likely as credentials are, and likelier one than an ordinary string."""
        return self._excess(text, symbols(text)) is not None

    def parts(self, run: str) -> list[tuple[int, int]]:
        """The accepted parts of a run as (from, to): the run with or without the marks at its ends, or else its parts between marks."""
        if (parts := self.known.get(run)) is None:
            if len(self.known) >= 1 << 18:  # bounds the memory of a worker, not the result
                self.known.clear()
            parts = self._parts(run)
            if len(run) <= 256:
                self.known[run] = parts
        return parts

    def _parts(self, run: str) -> list[tuple[int, int]]:
        inner = run.strip(_MARKS)
        spans = [(0, len(run))]
        if inner != run and len(inner) >= SHORTEST:
            at = run.index(inner)
            spans.append((at, at + len(inner)))
        between = [m.span() for m in _PART.finditer(run) if len(m[0]) >= SHORTEST] if any(c in inner for c in "./=") else []
        found = {(a, b): x for a, b in {*spans, *between} if (x := self._excess(run[a:b], symbols(run[a:b]))) is not None}
        whole = max((x for x in spans if x in found), key=found.get, default=None)
        pieces = [x for x in between if x in found]
        if whole and not any(found[x] > found[whole] + MARGIN for x in pieces):
            return [whole]
        return pieces


def gaps(length: int, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What sorted (start, kind, end) spans leave of a text."""
    out, at = [], 0
    for a, _, b in spans:
        if a > at:
            out.append((at, a))
        at = max(at, b)
    if at < length:
        out.append((at, length))
    return out


_SPANS = "array<struct<start:int,kind:int,end:int>>"
_ORDINARY, _RUNS = -1, -2


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The labelled credentials by kind, the strings outside base spans with how many texts hold them, and how many there are in all.

    low and high bound the digests of the texts that hold a string, so that it is known whether all of them are one text.
    """
    names, types = ["kind", "run", "n", "low", "high"], [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    least, most = -(1 << 63), (1 << 63) - 1
    held: dict[tuple[int, str], tuple[int, int | None]] = {}
    letters = 0

    def told() -> pa.RecordBatch:
        rows = [(k, run, n, least if h is None else h, most if h is None else h) for (k, run), (n, h) in held.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    for batch in slices(batches):
        for text in batch.column(0).to_pylist():
            if not text:
                continue
            spans = base_spans(text)
            runs = [run for a, b in gaps(len(text), spans) for run in RUN.findall(text, a, b)]
            digest = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
            found = {(k, ASSIGN.match(text, a)[2] if k == 0 else text[a:b]) for a, k, b in spans} | {(_ORDINARY, run) for run in runs}
            for key in found:
                if (old := held.get(key)) is None:
                    held[key] = 1, digest
                    letters += len(key[1])
                    if len(held) >= HELD or letters >= HELD_LETTERS:
                        yield told()
                        held.clear()
                        letters = 0
                else:
                    held[key] = old[0] + 1, old[1] if old[1] == digest else None
            if runs:
                held[_RUNS, ""] = held.get((_RUNS, ""), (0,))[0] + len(runs), None
    if held:
        yield told()


def _trees(rows: DataFrame) -> dict[int, Tree]:
    """The prefix trees of strings (run, n), summed by `part`: a row for each different path and letter reaches the driver."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in handing_back(batches):
            parts: dict[int, list[tuple[str, int]]] = {}
            for part, run, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts.setdefault(part, []).append((run, n))
            for part, strings in parts.items():
                for tree in grown(strings):
                    at, c, letter = zip(*tree, strict=True) if tree else ((), (), ())
                    yield pa.RecordBatch.from_arrays([pa.array([part] * len(at), pa.int32()), pa.array(at, pa.int64()), pa.array(c, pa.string()), pa.array(letter, pa.string()), pa.array(list(tree.values()), pa.int64())], ["part", "at", "symbol", "letter", "n"])

    out: dict[int, Tree] = {}
    grew = rows.select("part", "run", "n").mapInArrow(grow, "part int, at long, symbol string, letter string, n long")
    for r in grew.groupBy("part", "at", "symbol", "letter").agg(F.sum("n").alias("n")).collect():
        out.setdefault(r.part, {})[r["at"], r.symbol, r.letter] = r.n
    return out


def learned(strings: DataFrame) -> FormatModel:
    """The model of all credentials and all strings of a table (kind, run, n, lone); FormatModel's on the same rows.

    Every string is in a tree, every credential held out once. The driver has the trees' different paths and the automata.
    """
    model = FormatModel({}, {})
    bucket = F.shiftright(F.xxhash64("run"), 54)
    each = strings.where("kind >= 0").select("kind", "run", F.xxhash64("run").alias("h"), bucket.alias("b"))
    totals, offsets = Counter(), []
    for r in sorted(each.groupBy("kind", "b").count().collect(), key=lambda r: (r.kind, r.b)):
        offsets.append((r.kind, r.b, totals[r.kind]))
        totals[r.kind] += r["count"]
    if not totals:
        return model
    folds = {k: min(model.FOLDS, n) for k, n in totals.items()}
    of = F.create_map(*[F.lit(x) for pair in folds.items() for x in pair])
    spark = strings.sparkSession
    rank = F.row_number().over(Window.partitionBy("kind", "b").orderBy("h", "run")) - 1 + F.col("first")
    # As an Arrow table: a list would pass through Python workers of another kind, which stay beside the others.
    first = pa.table([pa.array(c, t) for c, t in zip(zip(*offsets, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["kind", "b", "first"])
    each = each.join(F.broadcast(spark.createDataFrame(first)), ["kind", "b"])
    each = staged(each.select("kind", "run", (rank % of[F.col("kind")]).cast("int").alias("fold")), "credentials")
    trees = _trees(each.select((F.col("kind") * 8 + F.col("fold")).alias("part"), "run", F.lit(1).cast("long").alias("n")))
    whole = {k: added(trees[k * 8 + f] for f in range(folds[k])) for k in folds}
    fitted = {(k, f): Automaton(tree=whole[k] if n == 1 else added([trees[k * 8 + f]], -1, whole[k])) for k, n in folds.items() for f in range(n)}

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in handing_back(batches):
            x = [(a.likelihood if folds[k] > 1 else a.without)(w, symbols(w)) / (len(w) + 1) for k, w, f in zip(*(c.to_pylist() for c in batch.columns), strict=True) for a in (fitted[k, f],)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.float64())], ["kind", "x"])

    held = each.mapInArrow(hold, "kind int, x double").groupBy("kind").agg(F.percentile("x", F.array(F.lit(STRANGE), F.lit(SEEDS))).alias("q"))
    better = []
    for kind, (low, seeds) in sorted((r.kind, r.q) for r in held.collect()):
        model.kinds.append((Automaton(tree=whole[kind]), low - MARGIN))
        better.append(seeds - model.kinds[-1][1])
    labelled, runs = sum(totals.values()), strings.where(F.col("kind") == _RUNS).agg(F.sum("n")).first()[0] or 0
    model.prior = math.log(labelled / (labelled + max(runs, 1)))
    ordinary = strings.where(F.col("kind") == _ORDINARY)
    every = _trees(ordinary.select(F.lit(0).alias("part"), "run", F.when(F.col("lone"), 1).otherwise(F.col("n")).cast("long").alias("n"))).get(0)
    if not every:
        return model

    def like(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in handing_back(batches):
            told = [(w, taken) for w in batch.column(0).to_pylist() if (taken := model.typical(w, better)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in told], pa.string()), pa.array([t for _, t in told], pa.bool_()), pa.array([True] * len(told), pa.bool_())], ["run", "taken", "changed"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in handing_back(batches):
            before = batch.column(1).to_pylist()
            after = [model.judged(w, taken) for w, taken in zip(batch.column(0).to_pylist(), before, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(after, pa.bool_()), pa.array([a != b for a, b in zip(after, before, strict=True)], pa.bool_())], ["run", "taken", "changed"])

    schema = "run string, taken boolean, changed boolean"
    typical = staged(ordinary.where("lone").select("run").mapInArrow(like, schema), "typical")
    for _ in range(model.ROUNDS):
        taken = _trees(typical.where("taken").select(F.lit(0).alias("part"), "run", F.lit(1).cast("long").alias("n"))).get(0, {})
        model.ordinary = Automaton(tree=added([taken], -1, every))
        typical = staged(typical.select("run", "taken").mapInArrow(judge, schema), "typical")
        if typical.where("changed").isEmpty():
            break
    return model


def _told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame, key: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, found.

    base_sha256 is the digest of the base spans, written kind:start:end in code points and joined by commas; spans has
    all spans so, and found holds them as structs (start, kind, end), kind 3 being the automata's. Null and empty texts
    have none. Texts of any length are scanned whole, and strings of any length scored; all of them are learned from. Repeated rows are scanned alike, and
    count once as labelled credentials; ties do not arise. Without a labelled credential the method adds no span. An empty table gives an
    empty result. key is a further column to carry; others are not read, so their names may clash.
    """
    extra = [key] if key else []
    text = docs.select("doc_id", "text", *extra)
    found = text.select("text").mapInArrow(_strings, "kind int, run string, n long, low long, high long")
    strings = found.groupBy("kind", "run").agg(F.sum("n").alias("n"), (F.min("low") == F.max("high")).alias("lone"))
    model = learned(staged(strings, "strings"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
        for batch in slices(batches):
            counts, digests, spans, every = [], [], [], []
            for value in batch.column(1).to_pylist():
                value = value or ""
                found = base_spans(value)
                more = list(found)
                for a, b in gaps(len(value), found) if model.kinds else []:
                    if any(model.parts(run) for run in set(RUN.findall(value, a, b))):
                        more += [(m.start() + x, 3, m.start() + y) for m in RUN.finditer(value, a, b) for x, y in model.parts(m[0])]
                more.sort()
                counts.append([sum(k == kind for _, k, _ in found) for kind in range(3)])
                digests.append(hashlib.sha256(_told(found).encode()).hexdigest())
                spans.append(_told(more))
                every.append([{"start": a, "kind": k, "end": b} for a, k, b in more])
            n = [pa.array([c[k] for c in counts], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *n, pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(every, span), *batch.columns[2:]], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found", *batch.schema.names[2:]])

    return text.mapInArrow(scan, f"doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found {_SPANS}{key_field(docs, key)}")


def redacted(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """A text with its spans masked, JVM-side; spans that overlap or touch are masked as one, a text without spans stays."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, span: Column) -> Column:
        fresh = (span["start"] > state["at"]) | ((span["start"] == 0) & (state["at"] == 0))
        more = F.concat(state["out"], F.substring(text, state["at"] + 1, F.greatest(F.lit(0), span["start"] - state["at"])), F.lit(mask))
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), F.when(fresh, more).otherwise(state["out"]).alias("out"))

    return F.when(F.size(spans) > 0, F.aggregate(ordered, zero, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))).otherwise(text)
