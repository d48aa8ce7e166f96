"""Abusive, hateful and sexually explicit language, by class-conditional Kneser-Ney models.

Two trigram models, of toxic and of ordinary language, share their backoff: below what a class has seen, both fall
back to one distribution of continuation counts, so an expression that neither knows counts for neither. A
text is read clause by clause in a normal form that undoes disguises (case, marks, look-alike letters,
digits for letters, drawn-out and spelled-out words, masked letters). The score of a window of words is its mean
log-likelihood ratio; a text's score is that of its highest window, and no lower than 0.

Nothing but labels and corpus teaches the models. From the labelled rows comes a first sorting of clauses: a
toxic row says that one of its clauses is toxic, a clean row that none is. The corpus shows in which
company an expression stands: how often it occurs, and whether it opens an inserted remark (after a colon, after an opening bracket or quotation
mark) or stands in the flow of speech. Expressions of labelled toxic clauses and those of ordinary ones differ in this profile,
and an expression without a label goes to the class whose labelled expressions have profiles like its own. So the
models learn expressions that no label holds from the contexts they share with labelled ones.

All counts cover all texts. Clauses are counted once for the corpus and judged once each, however often they occur.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators.skew import lookup_join
from tracewright.session import cut, fresh

DISCOUNT = 0.75
#: Words of a window at least and at most, and the score from which a text is a case.
WINDOW_MIN, WINDOW_MAX = 4, 7
THRESHOLD = 1.3
#: Score below which the best clause of a toxic row is not taken as the toxic one.
DOUBT = 0.1
#: Log-likelihood ratio of profiles, against all expressions of the corpus, from which a word and a trigram without a label count as toxic.
LEARNED_WORD, LEARNED = 1.5, 1.0
#: How far profiles of one class lie apart: pseudo-count of shares, width in the logarithm of the frequency.
ALIKE, BREADTH = 20.0, 1.0
#: Breadths beyond which a profile of another frequency adds nothing to a density.
FAR = 6.0
START, END, NUMBER, UNKNOWN = "<s>", "</s>", "<n>", "<u>"
#: Probability in the shared distribution of any word that the sample does not hold.
UNKNOWN_SHARE = 0.1
MEMO = 100_000

_HIDDEN = dict.fromkeys([0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0xFEFF])
#: Letters of other scripts and digits or signs that stand for Latin letters (fixed values).
_LOOKALIKE = str.maketrans("аеорсухіѕјкмтнвԁοαεικνρτυχı", "aeopcyxisjkmthbdoaeikvptuxi")
_LEET = str.maketrans("0134578@$!|€+", "oieastbasiiet")
#: A run of marks that may end a clause, with the space between and after them.
_MARK_RUN = re.compile(r"[.!?;:…\r\n()\[\]{}«»“”„\"—–¡¿\-](?:[.!?;:…()\[\]{}«»“”„\"—–¡¿\-]|\s)*")
_ALWAYS = re.compile(r"[\r\n()\[\]{}«»“”„\"—–¡¿]")
_ENDS = re.compile(r"[.!?;:…]")
_OPENERS = "([{«“„\""
_WORD = re.compile(r"[^\W_](?:[\w@$!|€+*#'’.\-]*[\w@$*#|])?[*#]*|[@$][\w@$!*#]+", re.UNICODE)
_SPELLED = re.compile(r"(?<![^\W\d_])(?:[^\W\d_]\s){2,}[^\W\d_](?![^\W\d_])")
_SINGLES = re.compile(r"\s[^\W\d_]\s[^\W\d_](?![^\W\d_])")
_FOREIGN = re.compile(r"[^\x00-\x7f]+")
_DRAWN = re.compile(r"([^\W\d_])\1{2,}")
_MARKS = regex.compile(r"\p{Mn}+")
_MASK = re.compile(r"[*#]+|(?<=\w)\.{2,}|(?<=\w)-{2,}|_{2,}")


@lru_cache(maxsize=MEMO)
def _bare(run: str) -> str:
    run = unicodedata.normalize("NFKC", run.translate(_HIDDEN)).lower().replace("ß", "ss").translate(_LOOKALIKE)
    return _MARKS.sub("", unicodedata.normalize("NFD", run))


def plain(text: str) -> str:
    if not text.isascii():
        text = _FOREIGN.sub(lambda m: _bare(m[0]), text)
    text = text.lower()
    return _SPELLED.sub(lambda m: re.sub(r"\s", "", m[0]), text) if _SINGLES.search(text) else text


@lru_cache(maxsize=MEMO)
def word_forms(w: str) -> tuple[str, ...]:
    """Normal form of a word as written: none, one, or the parts that apostrophes, points and hyphens separate."""
    if _MASK.search(w) and re.search(r"[^\W\d_]", w):
        w = _MASK.sub(lambda m: "?" * len(m[0]), w)
    if w[0].isdigit() and not re.search(r"[^\W\d_@$]", re.sub(r"[.,]?(st|nd|rd|th|e|er|a|o)$", "", w)):
        return (NUMBER,)
    if re.search(r"[\d@$!|€+]", w):
        w = w.translate(_LEET)
    w = _DRAWN.sub(r"\1", w).strip("'’.-")
    return tuple(x for x in re.split(r"['’.\-]+", w) if x)


def placed(text: str) -> Iterator[tuple[str, str]]:
    """Clauses of a text as written, each with its place: f in the flow, c after a colon, o after an opening mark."""
    at, place = 0, "f"
    for m in _MARK_RUN.finditer(text):
        start, end, run = m.start(), m.end(), m[0]
        marks = run.rstrip()
        after = text[start + len(marks) : start + len(marks) + 1]
        clear = not after or after.isspace() or after in "\"')]”»"
        if not (_ALWAYS.search(run) or (clear and _ENDS.search(marks)) or ("--" in marks and (not after or after.isspace() or text[start - 1 : start].isspace()))):
            continue
        if start > at and not text[at:start].isspace():
            yield text[at:start], place
            place = "f"
        if ":" in run:
            place = "c"
        elif place != "c":
            place = "o" if run[-1] in _OPENERS else "f"
        at = end
    if at < len(text) and not text[at:].isspace():
        yield text[at:], place


def clauses(text: str) -> Iterator[list[str]]:
    """Words of each clause in normal form. A masked word keeps ``?`` for each hidden letter; numbers in a row are one word."""
    for part, _ in placed(text):
        if words := words_of(part):
            yield words


def words_of(clause: str) -> list[str]:
    words: list[str] = []
    for w in _WORD.findall(plain(clause)):
        for x in (NUMBER,) if w.isdigit() else word_forms(w):
            if x != NUMBER or not words or words[-1] != NUMBER:
                words.append(x)
    return words


Gram = tuple[str, str, str]


def grams_of(words: list[str]) -> Iterator[Gram]:
    padded = [START, START, *words, END]
    return zip(padded, padded[1:], padded[2:], strict=False)


class Models:
    """The two class models with shared backoff, built from trigram counts of each class."""

    def __init__(self) -> None:
        self.gram = {c: Counter() for c in "to"}  # (u, v, w) and (v, w)
        self.total = {c: Counter() for c in "to"}  # contexts: (u, v) and (v,)
        self.kinds = {c: Counter() for c in "to"}  # distinct words after a context
        self.shared: dict[str, float] = {}
        self.rare = 0.0
        self.near: dict[str, str] = {}
        self.meant: dict[str, str] = {}
        self.masked: dict[str, list[str]] = {}
        self.vocabulary: set[str] = set()
        self.own: set[str] = set()

    @classmethod
    def fit(cls, toxic: Iterable[list[str]], ordinary: Iterable[list[str]]) -> Models:
        return cls.of_counts(Counter(g for s in toxic for g in grams_of(s)), Counter(g for s in ordinary for g in grams_of(s)))

    @classmethod
    def of_counts(cls, toxic: Counter, ordinary: Counter) -> Models:
        m = cls()
        pairs = {g[1:] for side in (toxic, ordinary) for g in side}
        after = Counter(w for _, w in pairs)
        whole = sum(after.values()) + len(after) + 1
        m.shared = {w: n / whole for w, n in after.items()}
        m.rare = 1 / whole
        m.shared[UNKNOWN] = UNKNOWN_SHARE
        m.vocabulary = set(after) - {END, NUMBER}
        for w in sorted(m.vocabulary):  # to find a word in which one letter is wrong
            if len(w) >= 5:
                for i in range(len(w)):
                    m.near.setdefault(w[:i] + "?" + w[i + 1 :], w)
        m.count("t", toxic)
        m.count("o", ordinary)
        return m

    def count(self, c: str, grams: Counter) -> None:
        gram, total, kinds = self.gram[c], self.total[c], self.kinds[c]
        for (u, v, w), n in grams.items():
            for g in ((u, v, w), (v, w)):
                kinds[g[:-1]] += g not in gram
                gram[g] += n
                total[g[:-1]] += n

    def p(self, c: str, u: str, v: str, w: str) -> float:
        gram, total, kinds = self.gram[c], self.total[c], self.kinds[c]
        p = self.shared.get(w, self.rare)
        if n := total.get((v,)):
            p = (max(gram.get((v, w), 0) - DISCOUNT, 0) + DISCOUNT * min(kinds[v,], n / DISCOUNT) * p) / n
        if n := total.get((u, v)):
            p = (max(gram.get((u, v, w), 0) - DISCOUNT, 0) + DISCOUNT * min(kinds[u, v], n / DISCOUNT) * p) / n
        return p

    def known(self, u: str, v: str, w: str) -> str:
        """The word meant by ``w``: a masked word is the likeliest known one that fits, a word with one wrong letter the known one.

        All other words are one unknown word, and so are words of their own (see ``_own_words``), though one letter away from a known one.
        """
        if w in self.vocabulary or w == NUMBER:
            return w
        if w in self.own:
            return UNKNOWN
        if "?" in w:
            fits = self._like(w)
            return max(fits, key=lambda x: (self.p("t", u, v, x) + self.p("o", u, v, x), x)) if fits else UNKNOWN
        if w not in self.meant:
            if len(self.meant) > MEMO:
                self.meant.clear()
            self.meant[w] = self.nearest(w)
        return self.meant[w]

    def nearest(self, w: str) -> str:
        if len(w) >= 5:
            for i in range(len(w)):
                if found := self.near.get(w[:i] + "?" + w[i + 1 :]):
                    return found
        return UNKNOWN

    def _like(self, w: str) -> list[str]:
        if w not in self.masked:
            if len(self.masked) > MEMO:
                self.masked.clear()
            pattern = re.compile("".join("." if x == "?" else re.escape(x) for x in w))
            loose = re.compile("".join(".*" if x == "?" else re.escape(x) for x in re.sub(r"\?+", "?", w)))
            exact = [x for x in self.vocabulary if pattern.fullmatch(x)]
            self.masked[w] = sorted(exact or [x for x in self.vocabulary if loose.fullmatch(x)])
        return self.masked[w]

    def read(self, words: list[str]) -> list[str]:
        out = [START, START]
        for w in words:
            out.append(self.known(out[-2], out[-1], w))
        return [*out, END]

    def score(self, words: list[str], none: float = 0.0) -> float:
        """Highest mean log-likelihood ratio of a window, a third of whose words or more the toxic model has in this order; ``none`` without any.

        What neither class has seen after the word before rests on the shared counts alone and says nothing; nor does how a
        clause begins: its first word tells the small toxic sample from the corpus, not toxic from ordinary. A shorter
        clause counts as one of the least length. A single word is a whole clause and is compared as such.
        """
        if len(words) < 2:
            whole = (START, *self.read(words)[2:])
            n = self.gram["t"].get(whole, 0)
            return math.log((n + 0.5) / (self.gram["o"].get(whole, 0) + 0.5)) if n else none
        s = self.read(words)
        t, o = self.gram["t"], self.gram["o"]
        known = [v != START and (v, w) in t for v, w in zip(s[1:], s[2:], strict=False)]
        if not any(known):
            return none
        n = len(known)
        hits = [0]
        for k in known:
            hits.append(hits[-1] + k)
        if n <= WINDOW_MIN:
            spans = []
        else:
            spans = [(a, b) for a in range(n) for b in range(a + WINDOW_MIN, min(n, a + WINDOW_MAX) + 1) if 3 * (hits[b] - hits[a]) >= b - a]
            if not spans and none == 0.0:
                return none  # most clauses end here, before any probability is computed
        r = [
            math.log(self.p("t", u, v, w) / self.p("o", u, v, w)) if k or (v != START and (v, w) in o) else 0.0
            for u, v, w, k in zip(s, s[1:], s[2:], known, strict=False)
        ]
        sums = [0.0]
        for x in r:
            sums.append(sums[-1] + x)
        if n <= WINDOW_MIN:
            return sums[-1] / WINDOW_MIN if 3 * hits[-1] >= n - 1 else min(0.0, sums[-1] / WINDOW_MIN)
        best = max(((sums[b] - sums[a]) / (b - a) for a, b in spans), default=None)
        return best if best is not None else min(0.0, sums[-1] / n)


class Scorer:
    """Scores of texts; clauses met again are remembered up to a bound."""

    def __init__(self, models: Models):
        self.models, self.memo = models, {}

    def clause(self, words: tuple[str, ...]) -> float:
        x = self.memo.get(words)
        if x is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            x = self.memo[words] = self.models.score(list(words))
        return x

    def text(self, text: str | None) -> float | None:
        if text is None:
            return None
        return max((0.0, *(self.clause(tuple(w)) for w in clauses(text))))


def cell(n: int, k: int, q: int) -> tuple[int, int, int]:
    return round(2 * math.log(n)), round(10 * k / n), round(10 * q / n)


class Profiles:
    """What company the expressions of each class keep: density over frequency and shares of places.

    A profile is (occurrences, of these after a colon, after an opening mark). Each expression is one kernel: log-normal in the
    frequency, Dirichlet-multinomial in the places. Expressions of one cell are one kernel with a weight, so that size does not grow with their number.
    """

    def __init__(self, toxic: Counter, ordinary: Counter):
        self.kernels = {}
        for c, cells in (("t", toxic), ("o", ordinary)):
            whole = sum(cells.values())
            self.kernels[c] = [
                (a / 2, [ALIKE * (x + 0.25) / 10.75 for x in (max(10 - b - d, 0), b, d)], math.log(m / whole)) for (a, b, d), m in sorted(cells.items())
            ]
        self.memo: dict[tuple[int, int, int], float] = {}

    def ratio(self, n: int, k: int, q: int) -> float:
        """Log-likelihood ratio of a profile; 0 where a class has no labelled expression."""
        if not self.kernels["t"] or not self.kernels["o"]:
            return 0.0
        key = (n, k, q)
        if key not in self.memo:
            self.memo[key] = self._density("t", n, k, q) - self._density("o", n, k, q)
        return self.memo[key]

    def _density(self, c: str, n: int, k: int, q: int) -> float:
        log_n, f, g = math.log(n), n - k - q, math.lgamma
        near = [x for x in self.kernels[c] if abs(log_n - x[0]) < FAR * BREADTH] or self.kernels[c]
        logs = []
        for mean, (a, b, d), weight in near:
            whole = a + b + d
            fit = g(whole) - g(whole + n) + g(a + f) - g(a)
            if k:
                fit += g(b + k) - g(b)
            if q:
                fit += g(d + q) - g(d)
            logs.append(weight + fit - (log_n - mean) ** 2 / (2 * BREADTH**2))
        top = max(logs)
        return top + math.log(sum(math.exp(x - top) for x in logs))


class Sample:
    """Clauses of the labelled rows, sorted into toxic and ordinary ones."""

    def __init__(self, rows: Iterable[tuple[str, str]]):
        rows = list(rows)
        self.clean = [w for t, c in rows if c == "clean" for w in clauses(t)]
        said = {g for w in self.clean for g in zip(w, w[1:], w[2:], strict=False)}

        def plainly(w: list[str], share: float = 0.7) -> bool:
            """Whether a clause is made up, to this share of its trigrams, of what clean clauses say."""
            grams = list(zip(w, w[1:], w[2:], strict=False))
            return (sum(g in said for g in grams) >= share * len(grams)) if grams else w in self.clean

        self.rows = []
        for text, category in rows:
            if category != "clean":
                row = list(clauses(text))
                self.clean += [w for w in row if plainly(w)]
                self.rows.append([w for w in row if not plainly(w)])
        self.toxic = [row[0] for row in self.rows if len(row) == 1] or [w for row in self.rows for w in row]
        self.ordinary = list(self.clean)

    def grams(self) -> set[Gram]:
        return {g for w in [*self.clean, *(w for row in self.rows for w in row)] for g in grams_of(w)}

    def sort_out(self, seen: dict[Gram, tuple[int, int, int]] | None = None, rounds: int = 4) -> Models:
        """Which clause of each toxic row is the toxic one; models of the sorted sample.

        A toxic row is known to hold something toxic, not where. Rows with one clause that no clean row explains are certain and give the
        first models. In each round a row's clause with the highest score counts as toxic, its others as ordinary, and a best
        clause in doubt as neither. With profiles of the corpus the score is the sum of both views.
        """
        models = Models.fit(self.toxic, self.clean)
        for _ in range(rounds):
            profiles = self.profiles(seen) if seen else None
            toxic, ordinary = [], list(self.clean)
            for row in self.rows:
                scores = [models.score(w, -1.0) + (self._profile(w, profiles, seen) if profiles else 0.0) for w in row]
                best = max(scores, default=0.0)
                for w, x in zip(row, scores, strict=True):
                    if x < best:
                        ordinary.append(w)
                    elif x >= DOUBT or len(row) == 1:
                        toxic.append(w)
            if not toxic:
                break
            self.toxic, self.ordinary = toxic, ordinary
            models = Models.fit(toxic, ordinary)
        return models

    @staticmethod
    def _profile(w: list[str], profiles: Profiles, seen: dict) -> float:
        found = [min(3.0, max(-3.0, profiles.ratio(*seen[g]))) for g in grams_of(w) if g in seen]
        return sum(found) / len(found) if found else 0.0

    def sides(self) -> tuple[set[Gram], set[Gram]]:
        """Trigrams of toxic clauses alone, and all of ordinary ones."""
        ordinary = {g for w in self.ordinary for g in grams_of(w)}
        return {g for w in self.toxic for g in grams_of(w)} - ordinary, ordinary

    def profiles(self, seen: dict[Gram, tuple[int, int, int]]) -> Profiles:
        toxic, ordinary = self.sides()
        return Profiles(Counter(cell(*seen[g]) for g in toxic if g in seen), Counter(cell(*seen[g]) for g in ordinary if g in seen))


# -- the corpus -------------------------------------------------------------------------------------------------------------------------

def read_corpus(df: DataFrame, text: str, key: str) -> DataFrame:
    """One pass over the texts. A text gives a row ``key, ids`` with the ids of its clauses; each clause a row ``words, n, k, q`` from each task.

    ``words`` is the normal form, its id the hash of it; ``n, k, q`` are its occurrences, those after a colon and those after an opening mark.
    The rows of both kinds are written once and read by all later steps. A null key is kept, a null text gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}
        forms: dict[str, tuple[str, int]] = {}

        def out() -> pa.RecordBatch:
            counts = [pa.array([x[i] for x in held.values()], pa.int64()) for i in range(3)]
            columns = [pa.nulls(len(held), kind), pa.nulls(len(held), pa.list_(pa.int64())), pa.array(list(held), pa.string()), *counts]
            held.clear()
            return pa.record_batch(columns, names=["key", "ids", "words", "n", "k", "q"])

        for batch in batches:
            kind, ids = batch.column(0).type, []
            for t in batch.column(1).to_pylist():
                own: list[int] = []
                for raw, place in placed(t):
                    found = forms.get(raw)
                    if found is None:
                        if len(forms) >= MEMO:
                            forms.clear()
                        words = " ".join(words_of(raw))
                        found = forms[raw] = (words, clause_id(words))
                    words, i = found
                    if words:
                        own.append(i)
                        x = held.get(words)
                        if x is None:
                            x = held[words] = [0, 0, 0]
                        x[0] += 1
                        if place != "f":
                            x[1 if place == "c" else 2] += 1
                ids.append(own)
            rest = [pa.nulls(len(ids), pa.string()), *(pa.nulls(len(ids), pa.int64()) for _ in range(3))]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int64())), *rest], names=["key", "ids", "words", "n", "k", "q"])
            if len(held) > MEMO:
                yield out()
        if held:
            yield out()

    kept = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    return cut(kept.mapInArrow(run, f"key {kept.schema['key'].dataType.simpleString()}, ids array<bigint>, words string, n bigint, k bigint, q bigint"))


def clause_id(words: str) -> int:
    return int.from_bytes(blake2b(words.encode(), digest_size=8).digest(), "big", signed=True)


def clause_table(corpus: DataFrame) -> DataFrame:
    """``words, n, k, q`` of each distinct clause of ``read_corpus``."""
    return cut(corpus.where("words is not null").groupBy("words").agg(*(F.sum(c).alias(c) for c in "nkq")))


def gram_table(table: DataFrame) -> DataFrame:
    """``gram`` (three words joined by blanks), ``n``, ``k``, ``q`` over all clauses; counted within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[Gram, list[int]] = {}

        def out() -> pa.RecordBatch:
            names = pa.array([" ".join(g) for g in held], pa.string())
            columns = [pa.array([x[i] for x in held.values()], pa.int64()) for i in range(3)]
            held.clear()
            return pa.record_batch([names, *columns], names=["gram", "n", "k", "q"])

        for batch in batches:
            for words, n, k, q in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for g in grams_of(words.split(" ")):
                    x = held.get(g)
                    if x is None:
                        held[g] = [n, k, q]
                    else:
                        x[0] += n
                        x[1] += k
                        x[2] += q
            if len(held) > 200_000:
                yield out()
        if held:
            yield out()

    partial = table.select("words", "n", "k", "q").mapInArrow(run, "gram string, n bigint, k bigint, q bigint")
    return cut(partial.groupBy("gram").agg(*(F.sum(c).alias(c) for c in "nkq")))


def _picked(grams: DataFrame, keep, state) -> DataFrame:
    """Rows of ``grams`` for which ``keep(state, gram, n, k, q)`` holds, in Arrow batches; ``state`` is a broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = state.value
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            yield batch.filter(pa.array([keep(held, tuple(g.split(" ")), n, k, q) for g, n, k, q in rows], pa.bool_()))

    return grams.select("gram", "n", "k", "q").mapInArrow(run, "gram string, n bigint, k bigint, q bigint")


def _gather(rows: DataFrame) -> dict[Gram, tuple[int, int, int]]:
    return {tuple(r["gram"].split(" ")): (r["n"], r["k"], r["q"]) for r in rows.collect()}


def _toxic_word(held: tuple[Profiles, set[str]], g: tuple[str], n: int, k: int, q: int) -> bool:
    profiles, ordinary = held
    return g[0] not in ordinary and "?" not in g[0] and profiles.ratio(n, k, q) >= LEARNED_WORD


def _cells(table: DataFrame) -> Counter:
    """Number of expressions of ``table`` in each cell of profiles: at most 121 for each step of the frequency's logarithm."""
    n = F.col("n")
    at = [F.round(x).cast("int").alias(c) for x, c in ((2 * F.log(n), "a"), (10 * F.col("k") / n, "b"), (10 * F.col("q") / n, "d"))]
    return Counter({(r["a"], r["b"], r["d"]): r["m"] for r in table.select(*at).groupBy("a", "b", "d").agg(F.count(F.lit(1)).alias("m")).collect()})


def _learnable(held: tuple[Profiles, set[Gram]], g: Gram, n: int, k: int, q: int) -> bool:
    profiles, labelled = held
    return g not in labelled and not any("?" in x for x in g) and profiles.ratio(n, k, q) >= LEARNED


def fit_models(labels: DataFrame, table: DataFrame, *, label_rows: int | None = None) -> Models:
    """Models from labels (``example_id, text, category``; rows with a null are left out) and the clauses of a corpus (``clause_table``).

    What reaches the driver is what the models hold: the labelled rows (all, or the ``label_rows`` of smallest ids if given), counts of their trigrams, the learned
    trigrams and words, and what follows the contexts of both in the corpus. Learned trigrams count only where two overlap, so an expression has four words or is a whole clause.
    """
    spark = table.sparkSession
    rows = labels.where("text is not null and category is not null").orderBy("example_id", "text")
    rows = (rows if label_rows is None else rows.limit(label_rows)).select("text", "category").collect()
    sample = Sample((r["text"], r["category"]) for r in rows)
    grams = gram_table(table)
    seen = _gather(_picked(grams, lambda held, g, n, k, q: g in held, spark.sparkContext.broadcast(sample.grams())))
    sample.sort_out()
    sample.sort_out(seen)
    toxic, ordinary = sample.sides()
    profiles = sample.profiles(seen)
    # a labelled toxic clause shares trigrams with ordinary ones that have no label
    toxic = {g for g in toxic if g not in seen or profiles.ratio(*seen[g]) > -LEARNED}
    vocabulary = _word_table(grams)
    words, company = _toxic_words(vocabulary, toxic, ordinary)
    against = Profiles(Counter(cell(*seen[g]) for g in toxic if g in seen), _cells(grams))
    state = spark.sparkContext.broadcast((against, toxic | ordinary))
    learned = cut(_picked(grams, _learnable, state))
    counts = Counter({g: seen[g][0] for g in toxic if g in seen})
    counts.update({g: x[0] for g, x in _gather(joined(learned, toxic, words)).items()})
    own = set(counts)
    counts.update(g for w in sample.toxic for g in grams_of(w) if g not in own)
    models = Models.of_counts(counts, Counter(g for w in sample.ordinary for g in grams_of(w)))
    models.own = _own_words(vocabulary, models, company)
    contexts = {g[:2] for g in counts} | {g[1:2] for g in counts}
    after: Counter = Counter()
    for g, (n, _, _) in _gather(_picked(grams, _follows, spark.sparkContext.broadcast((contexts, own)))).items():
        after[g[0], g[1], g[2] if g[2] == END else models.known(*g)] += n
    for g in own:
        after.pop(g, None)
    models.count("o", after)
    return models


def _follows(held: tuple[set[tuple], set[Gram]], g: Gram, n: int, k: int, q: int) -> bool:
    contexts, own = held
    return (g[1:2] in contexts or g[:2] in contexts) and g not in own


def _word_table(grams: DataFrame) -> DataFrame:
    """``gram`` (one word), ``n``, ``k``, ``q`` of each word of the corpus."""
    return cut(grams.groupBy(F.substring_index("gram", " ", -1).alias("gram")).agg(*(F.sum(c).alias(c) for c in "nkq")))


def _toxic_words(table: DataFrame, toxic: set[Gram], ordinary: set[Gram]) -> tuple[set[str], Profiles]:
    """Words of toxic language: those labelled so, and those whose profile in the corpus is like theirs. With the profiles."""
    said = {x for g in ordinary for x in g}
    labelled = {x for g in toxic for x in g} - said
    context = table.sparkSession.sparkContext
    seen = _gather(_picked(table, lambda held, g, n, k, q: g[0] in held, context.broadcast(labelled)))
    profiles = Profiles(Counter(cell(*x) for g, x in seen.items() if g[0] in labelled), _cells(table))
    found = _gather(_picked(table, _toxic_word, context.broadcast((profiles, said | labelled))))
    return labelled | {g[0] for g in found}, profiles


def _own_words(table: DataFrame, models: Models, profiles: Profiles) -> set[str]:
    """Words that are one letter away from a known one and yet no misspelling of it: the corpus has them more often, in no toxic company.

    Else a misspelling learned from an ordinary sentence would stand for the right word wherever that occurs.
    """
    context = table.sparkSession.sparkContext
    often = {g[0]: x[0] for g, x in _gather(_picked(table, lambda held, g, n, k, q: g[0] in held, context.broadcast(models.vocabulary))).items()}
    return {g[0] for g in _gather(_picked(table, _own_word, context.broadcast((models, often, profiles))))}


def _own_word(held: tuple[Models, dict[str, int], Profiles], g: tuple[str], n: int, k: int, q: int) -> bool:
    models, often, profiles = held
    if g[0] in models.vocabulary or "?" in g[0]:
        return False
    meant = models.nearest(g[0])
    return meant != UNKNOWN and n > often.get(meant, 0) and profiles.ratio(n, k, q) <= 0


def joined(learned: DataFrame, labelled: set[Gram], words: set[str]) -> DataFrame:
    """Learned trigrams that hold a toxic word or share two words in a row with one that does; of these, such as do not stand alone.

    A trigram stands alone if it shares no two words in a row with another one, learned or labelled, and is no whole clause. All of ``learned`` is looked
    at where it lies; only what is kept reaches the driver.
    """
    spark = learned.sparkSession
    first, last = F.substring_index("gram", " ", 2), F.substring_index("gram", " ", -2)

    def beside(grams: DataFrame, others: DataFrame) -> DataFrame:
        def near(mine, theirs) -> DataFrame:
            ends = others.groupBy(theirs.alias("pair")).agg(F.min("gram").alias("low"), F.max("gram").alias("high"))
            return lookup_join(grams.withColumn("pair", mine), ends, "pair", "inner").where("low <> gram or high <> gram").select("gram", "n", "k", "q")

        return near(first, last).unionByName(near(last, first))

    held = spark.sparkContext.broadcast(words)
    core = cut(_picked(learned, lambda words, g, n, k, q: not words.isdisjoint(g), held))
    core = cut(core.unionByName(beside(learned, core)).distinct())
    known = spark.createDataFrame([(" ".join(g),) for g in labelled], "gram string")
    whole = core.where(F.col("gram").startswith(f"{START} ") & F.col("gram").endswith(f" {END}"))
    return beside(core, core.select("gram").unionByName(known)).unionByName(whole).distinct()


def clause_scores(table: DataFrame, models: Models, least: float = 0.0) -> DataFrame:
    """``id, score`` of the clauses of ``clause_table`` that score above 0 and at least ``least``."""
    state = table.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = state.value
        for batch in batches:
            kept = [(w, x) for w in batch.column(0).to_pylist() if (x := models.score(w.split(" "))) > 0 and x >= least]
            yield pa.record_batch([pa.array([clause_id(w) for w, _ in kept], pa.int64()), pa.array([x for _, x in kept], pa.float64())], names=["id", "score"])

    return table.select("words").mapInArrow(run, "id bigint, score double")


def text_scores(corpus: DataFrame, scores: DataFrame) -> DataFrame:
    """``key, score`` of the texts of ``read_corpus`` that hold a clause of ``scores``: the highest of each key."""
    rows = corpus.where("ids is not null").select("key", F.explode("ids").alias("id"))
    return lookup_join(rows, cut(scores), "id", "inner").groupBy("key").agg(F.max("score").alias("score"))


def score_texts(df: DataFrame, text: str, key: str, labels: DataFrame, *, score: str = "score", label_rows: int | None = None) -> DataFrame:
    """``df`` with the toxic score of ``text`` (double): null for null, 0 for texts without words and without toxic language.

    ``key`` identifies a text: rows of equal key have the highest score among their texts, null being a key as well. A column named ``score`` is replaced.
    """
    corpus = read_corpus(df, text, key)
    table = clause_table(corpus)
    name, scored = fresh(df, "key"), fresh(df, "scored")
    found = text_scores(corpus, clause_scores(table, fit_models(labels, table, label_rows=label_rows))).select(F.col("key").alias(name), F.col("score").alias(scored))
    out = df.join(found, F.col(key).eqNullSafe(F.col(name)), "left").drop(name)
    return out.withColumn(score, F.when(F.col(text).isNotNull(), F.coalesce(F.col(scored), F.lit(0.0)))).drop(scored)
