"""Licence scans: a logistic regression over word n-grams, learned from licence texts, applied to paragraphs and lines in the JVM.

Scoring uses DataFrame and SQL functions only: paragraphs and lines of a text are arrays inside its row, so nothing is shuffled.
"""

from __future__ import annotations

import functools
import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound
from .licence_texts import FAMILIES, FILLERS, PLAIN_LINES, UNKNOWN_LINES

PLAIN, OTHER = "none", "unknown"
#: n-grams up to so many words; varied copies of each text; steps and penalty of the regression.
GRAM, COPIES, STEPS, PENALTY = 2, 12, 300, 1e-4
#: What a template must share of its word pairs, and the precision that a family's name must have on held-out notices by the classifier alone.
CONFIRMED, PRECISION = 0.6, 0.75
#: Parts of the notices of a family, of which one is held out in turn.
FOLDS = 3
#: Beginnings of words that are marks besides those learned: other spellings, and names that stand for a licence alone.
NAMES = ("licenc", "gpl", "lgpl", "agpl", "apache", "bsd", "mpl", "epl")
#: Lines around one with a mark that are its paragraph, besides the whole one; lines of more characters are looked at by sentence.
NEAR, LONG_LINE = 4, 1_000
#: Features are found by checksum in so many slots, not by a walk over all of them.
SLOTS = 8192
_WORD = re.compile(r"[a-z0-9]+")
_SENTENCE = r"(?<=[.!?])\s+"
#: A line that is blank but for the marks of a comment.
_BLANK = r"^[\s/*#;%>|<!\-\"']*$"
#: Words that mark a line as a comment.
_COMMENT_WORDS = ("rem", "dnl")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower().replace("licence", "license"))


def grams(w: list[str]) -> set[str]:
    return {" ".join(w[i : i + n]) for n in range(1, GRAM + 1) for i in range(len(w) - n + 1)}


def pairs(w: list[str]) -> set[str]:
    """Neighbouring words; a single word stands for itself."""
    return {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)} or set(w)


@dataclass(frozen=True)
class Classifier:
    classes: tuple[str, ...]
    #: Features, those of one word first; weights by feature and class; how many have one word.
    weights: dict[str, tuple[float, ...]]
    singles: int
    bias: tuple[float, ...]
    #: By class: weight of the share of word pairs that are no features.
    strange: tuple[float, ...]
    temperature: float
    #: A family is named from this calibrated probability.
    sure: float
    #: Words and pairs of words: what has none of them is plain text by the scores (see `_needed`).
    cues: tuple[str, ...]
    #: Beginnings of words; lines near one are a paragraph of their own, besides the whole one.
    marks: tuple[str, ...]

    def scores(self, w: list[str]) -> np.ndarray:
        """What the scan gives a line or paragraph, in plain Python."""
        found = [g for g in grams(w) if g in self.weights]
        known = sum(" " in g for g in found)
        share = 1 - known / max(1, len(pairs(w)))
        return np.array(self.bias) + share * np.array(self.strange) + sum((np.array(self.weights[g]) for g in found), np.zeros(len(self.classes)))


def _varied(rng: np.random.Generator, w: list[str]) -> list[str]:
    """The words with a few dropped or added, or a stretch alone, as notices are found."""
    if len(w) > 24 and rng.random() < 0.5:  # a notice is often quoted in part, or broken into lines
        n = int(rng.integers(12, len(w)))
        at = int(rng.integers(0, len(w) - n + 1))
        w = w[at : at + n]
    out = [x for x in w if rng.random() > 0.06] or list(w)
    for _ in range(rng.integers(0, 3)):
        out.insert(int(rng.integers(0, len(out) + 1)), str(rng.choice(FILLERS)))
    return out


def _cover(texts: list[list[str]], common: set[str]) -> tuple[str, ...]:
    """Few beginnings of words such that every text has one at least, and a text of over 20 words two: the most frequent first."""
    rest, out = [(t, {x[:7] for x in t if len(x) >= 4 and x.isalpha() and x not in common}) for t in texts], []
    need = [min(1 + (len(t) > 20), len(stems)) for t, stems in rest]
    while any(need):
        count: dict[str, int] = {}
        for n, (_, stems) in zip(need, rest, strict=True):
            for x in stems if n else ():
                count[x] = count.get(x, 0) + (x not in out)
        best = min(count, key=lambda x: (-count[x], x))
        if not count[best]:
            break
        out.append(best)
        need = [n - (best in stems) if n else 0 for n, (_, stems) in zip(need, rest, strict=True)]
    return tuple(sorted(out))


def _needed(weights: dict[str, tuple[float, ...]], constant: np.ndarray, plain: int) -> tuple[str, ...]:
    """Words and pairs of words, such that words with none of them are likeliest plain, whatever else they are.

    Without any feature the scores are `constant` (bias, and all pairs strange), and plain is first. Words are passed over, the
    shortest first, as long as all of them together, each with the most that it adds to a class against plain, leave plain first. A pair
    that only has such words would also make pairs less strange, so it is needed itself.
    """
    lead = constant[plain] - np.delete(constant, plain)
    gain = {g: np.maximum(0.0, np.delete(np.array(w) - w[plain], plain)) for g, w in weights.items()}
    all_ = {x for g in weights for x in g.split()}
    rest, spent = {x for x in all_ if x not in gain}, np.zeros(len(lead))  # fillers have no weight alone
    for x in sorted(all_ - rest, key=lambda x: (len(x), x)):
        if (spent + gain[x] < lead - 0.01).all():
            rest.add(x)
            spent = spent + gain[x]
    out = (all_ - rest) | {g for g in weights if " " in g and all(x in rest for x in g.split())}
    return tuple(sorted(out | {x.replace("license", "licence") for x in out}))


def _gate(cues: tuple[str, ...]) -> str:
    """A pattern for lower-case text with one of the cues; words of a pair may have the mark of a comment between them."""
    between = "[^a-z0-9]+(?:(?:" + "|".join(_COMMENT_WORDS) + ")[^a-z0-9]+)?"
    first: dict[str, list[str]] = {}
    for c in cues:
        first.setdefault(c[0], []).append(c[1:].replace(" ", between))
    return "(?<![a-z0-9])(?:" + "|".join(f"{c}(?:{'|'.join(ends)})" for c, ends in sorted(first.items())) + ")(?![a-z0-9])"


@functools.cache
def learn(seed: int = 5) -> Classifier:
    """Fit on varied licence texts, lines about unnamed licences and running text; calibrate on notices that were held out.

    Each of FOLDS parts of the notices, with all their copies, is scored by a model of the others. The temperature is that of the
    least held-out loss. The probability from which a family is named is the least that gives PRECISION among held-out notices,
    before any template is looked at; what stays below is `unknown`.
    """
    rng = np.random.default_rng(seed)
    classes = (*sorted(FAMILIES), OTHER, PLAIN)
    texts = [(c, words(t), i % FOLDS) for c, ts in FAMILIES.items() for i, t in enumerate(ts)] + [(OTHER, words(t), i % FOLDS) for i, t in enumerate(UNKNOWN_LINES)]
    rows = texts + [(c, _varied(rng, w), f) for c, w, f in texts for _ in range(COPIES)]
    plain = [words(t) for t in PLAIN_LINES]
    rows += [(PLAIN, _varied(rng, w), i % FOLDS) for i, w in enumerate(plain) for _ in range(COPIES // 2)]
    vocabulary = sorted({x for _, w, _ in texts for x in w})
    for i in range(60 * COPIES):  # running text, with single words of licences in it
        w = [str(x) for x in rng.choice(FILLERS, rng.integers(3, 40))]
        for _ in range(rng.integers(0, 3)):
            w.insert(int(rng.integers(0, len(w) + 1)), str(rng.choice(vocabulary)))
        rows.append((PLAIN, w, i % FOLDS))
    common = set(FILLERS)
    found = {g for _, w, _ in texts for g in grams(w) if any(x not in common for x in g.split())}
    features = sorted(found, key=lambda g: (" " in g, g))
    at = {g: i for i, g in enumerate(features)}
    singles = sum(" " not in g for g in features)
    y = np.array([classes.index(c) for c, _, _ in rows])
    fold = np.array([f for _, _, f in rows])

    def matrix(known: set[str]) -> np.ndarray:
        """Features by row, of those grams that are known."""
        x = np.zeros((len(rows), len(features) + 1), np.float32)
        for r, (_, w, _) in enumerate(rows):
            hit = [at[g] for g in grams(w) if g in known]
            x[r, hit] = 1
            x[r, -1] = 1 - sum(i >= singles for i in hit) / max(1, len(pairs(w)))
        return x

    held = np.zeros((len(rows), len(classes)), np.float32)
    for f in range(FOLDS):  # what is held out are notices, with all their copies, and the grams that they alone have
        x = matrix({g for _, w, k in texts if k != f for g in grams(w)} & found)
        weights, bias = _regression(x[fold != f], y[fold != f], len(classes))
        held[fold == f] = x[fold == f] @ weights + bias
    loss = [(float(-np.log(_softmax(held / t)[np.arange(len(y)), y] + 1e-12).mean()), t) for t in np.linspace(0.2, 3, 29)]
    temperature = min(loss)[1]
    p = _softmax(held / temperature)
    said, sure = p.argmax(1), p.max(1)
    named = np.flatnonzero(said < classes.index(OTHER))
    order = named[np.argsort(-sure[named], kind="stable")]
    right = np.cumsum(said[order] == y[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(right >= PRECISION)
    least = float(sure[order[good[-1]]]) if len(good) else 1.0
    weights, bias = _regression(matrix(found), y, len(classes))
    kept = {g: tuple(np.round(weights[i].astype(float), 4).tolist()) for g, i in at.items()}
    tidy = lambda v: tuple(np.round(v.astype(float), 4).tolist())
    bias, strange = tidy(bias), tidy(weights[-1])
    marks = _cover([w for _, w, _ in texts], common | {x for w in plain for x in w} - {"license", "permission", "warranty"} | {"https"})
    cues = _needed(kept, np.array(bias) + np.array(strange), classes.index(PLAIN))
    return Classifier(classes, kept, singles, bias, strange, float(temperature), round(least, 6), cues, tuple(sorted({*marks, *NAMES})))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _regression(x: np.ndarray, y: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression with an L2 penalty, by gradient steps with momentum; classes count alike."""
    target = np.eye(classes, dtype=np.float32)[y]
    share = (1 / np.maximum(target.sum(0), 1))[y]
    share = (share / share.sum()).astype(np.float32)
    w, b = np.zeros((x.shape[1], classes), np.float32), np.zeros(classes, np.float32)
    vw, vb = w.copy(), b.copy()
    for _ in range(STEPS):
        error = (_softmax(x @ w + b) - target) * share[:, None]
        vw = 0.9 * vw - 3.0 * (x.T @ error + PENALTY * w)
        vb = 0.9 * vb - 3.0 * error.sum(0)
        w, b = w + vw, b + vb
    return w, b


def _words(line: Column) -> Column:
    return F.regexp_extract_all(F.replace(F.lower(line), F.lit("licence"), F.lit("license")), F.lit("([a-z0-9]+)"), 1)


def _array(values, kind: str) -> Column:
    """A literal array of values without commas, as one expression that is folded once."""
    return F.split(F.lit(",".join(map(str, values))), ",", -1).cast(f"array<{kind}>")


def _pairs(w: Column) -> Column:
    """Distinct neighbouring words; a single word stands for itself."""
    two = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i)))
    return F.array_distinct(F.when(F.size(w) >= 2, two).otherwise(w))


def _scored(w: Column, model: Classifier) -> Column:
    """The scores of a line's or paragraph's words, a number for each class."""
    slots = [""] * SLOTS
    for i, g in enumerate(model.weights):
        slots[zlib.crc32(g.encode()) % SLOTS] += f"|{g}={i}|"
    table, weights = _array(slots, "string"), _array([x for v in model.weights.values() for x in v], "double")
    classes = len(model.classes)
    bias, strange = _array(model.bias, "double"), _array(model.strange, "double")

    def place(g: Column) -> Column:
        slot = F.get(table, (F.crc32(g.cast("binary")) % SLOTS).cast("int"))
        return bound(F.instr(slot, F.concat(F.lit("|"), g, F.lit("="))), lambda p: F.when(p > 0, F.substring_index(F.substr(slot, p + F.length(g) + 2), "|", 1).cast("int")))

    def summed(two: Column) -> Column:
        all_ = F.array_distinct(F.concat(w, F.when(F.size(w) >= 2, two).otherwise(F.array().cast("array<string>"))))
        found = F.array_compact(F.transform(all_, place))

        def scores(at: Column) -> Column:
            share = 1 - F.size(F.filter(at, lambda i: i >= model.singles)) / F.greatest(F.lit(1), F.size(two))
            return bound(share, lambda s: F.transform(bias, lambda b, c: F.aggregate(at, b + s * F.get(strange, c), lambda acc, i: acc + F.get(weights, i * classes + c))))

        return bound(found, scores)

    return bound(_pairs(w), summed)


def _lines(text: Column, model: Classifier) -> Column:
    """Lines (long ones by sentence): struct<line,words,cue,mark,blank>, and near: whether a line with a mark is near."""
    gate, mark = _gate(model.cues), r"(?i)\b(?:" + "|".join(model.marks) + ")"
    split = F.flatten(F.transform(F.split(text, "\n", -1), lambda s, i: F.transform(F.when(F.length(s) > LONG_LINE, F.split(s, _SENTENCE, -1)).otherwise(F.array(s)), lambda u: F.struct(i.alias("line"), u.alias("text")))))
    told = F.transform(split, lambda x: F.struct(x["line"].alias("line"), _words(x["text"]).alias("words"), F.lower(x["text"]).rlike(gate).alias("cue"), x["text"].rlike(mark).alias("mark"), x["text"].rlike(_BLANK).alias("blank")))

    def near(ls: Column) -> Column:
        def kept(f: Column) -> Column:
            around = lambda i: F.exists(F.slice(f, F.greatest(i - NEAR + 1, F.lit(1)), F.lit(2 * NEAR + 1)), lambda c: c)
            return F.transform(ls, lambda x, i: F.struct(*(x[c].alias(c) for c in ("line", "words", "cue", "mark", "blank")), around(i).alias("near")))

        return bound(F.transform(ls, lambda x: x["mark"]), kept)

    return bound(told, near)


def _paragraphs(lines: Column) -> Column:
    """Of lines (line, words, apart, holds) the runs of two and more without one that stands apart, if one holds: struct<line,last,words>."""
    ends = F.array_append(F.transform(F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x["apart"].alias("apart"))), lambda x: x["apart"]), lambda x: x["i"]), F.size(lines))
    bare = lambda w: F.when(F.get(w, F.lit(0)).isin(*_COMMENT_WORDS), F.slice(w, 2, F.size(w))).otherwise(w)

    def runs(ends: Column) -> Column:
        spans = F.transform(ends, lambda e, k: F.struct((F.coalesce(F.get(ends, k - 1), F.lit(-1)) + 1).alias("a"), (e - 1).alias("z")))
        held = F.transform(F.filter(spans, lambda p: p["z"] > p["a"]), lambda p: F.slice(lines, p["a"] + 1, p["z"] - p["a"] + 1))
        some = F.filter(held, lambda ls: F.exists(ls, lambda x: x["holds"]))
        return F.transform(some, lambda ls: F.struct(F.get(ls, F.lit(0))["line"].alias("line"), F.element_at(ls, -1)["line"].alias("last"), F.flatten(F.transform(ls, lambda x: bare(x["words"]))).alias("words")))

    return bound(ends, runs)


def with_licences(docs: DataFrame, model: Classifier | None = None, *, text: str = "text") -> DataFrame:
    """docs with notices: array<struct<line,last,family,probability,confirmed>> of the paragraphs and lines that are licence notices.

    Every line (by sentence, if over LONG_LINE characters), every paragraph (a run of lines without a blank one; line breaks and
    comment marks are spaces) and, within it, every run of lines near a mark is judged. Without a cue all of these are plain by
    their scores, whatever their other words are, so they needn't be computed. Lines are numbered from 0, by \\n alone. A notice is
    what isn't likeliest running text. Its family is the likeliest if that is sure and a template of it shares CONFIRMED of its word
    pairs; else "unknown". Of equal scores the first class in alphabetical order holds. Where a paragraph names a family that no
    line of it, nor a run within it, names alone, the notice stands at the paragraph, in place of its unknown lines; an unknown one
    stands if nothing in it is a notice.

    Null and empty texts have no notices. Repeated rows and null ids stay as they are, an empty table gives an empty one, a column
    named notices is replaced, all others stay.
    """
    model = model or learn()
    classes = F.array(*[F.lit(c) for c in model.classes])
    known = {f: [sorted(pairs(words(t))) for t in ts] for f, ts in FAMILIES.items()}
    templates = F.create_map(*[v for f, ts in known.items() for v in (F.lit(f), F.array(*[_array(t, "string") for t in ts]))])

    def judged(x: Column) -> Column:
        top = F.array_max(x["z"])
        total = F.aggregate(x["z"], F.lit(0.0), lambda s, v: s + F.exp((v - top) / F.lit(model.temperature)))
        family = F.element_at(classes, F.array_position(x["z"], top).cast("int"))
        return F.struct(x["line"].alias("line"), x["last"].alias("last"), x["words"].alias("words"), family.alias("family"), (F.lit(1.0) / total).alias("probability"))

    def checked(x: Column) -> Column:
        share = bound(_pairs(x["words"]), lambda p: F.transform(F.element_at(templates, x["family"]), lambda t: F.size(F.array_intersect(t, p)) / F.size(t)))
        confirmed = F.coalesce(F.array_max(share) >= CONFIRMED, F.lit(False))
        return bound(confirmed, lambda c: F.struct(x["line"].alias("line"), x["last"].alias("last"), F.when((x["probability"] >= model.sure) & c, x["family"]).otherwise(F.lit(OTHER)).alias("family"), F.round(x["probability"], 6).alias("probability"), c.alias("confirmed")))

    def found(spans: Column) -> Column:
        """Notices among spans of line, last and words."""
        scored = F.transform(spans, lambda x: F.struct(x["line"].alias("line"), x["last"].alias("last"), x["words"].alias("words"), _scored(x["words"], model).alias("z")))
        return F.transform(F.filter(F.transform(scored, judged), lambda x: x["family"] != PLAIN), checked)

    def merged(all_: Column) -> Column:
        inside = lambda x, p: (x["line"] >= p["line"]) & (x["last"] <= p["last"])
        named = lambda ps, known: F.filter(ps, lambda p: (p["family"] != OTHER) & ~F.exists(known, lambda x: inside(x, p) & (x["family"] == p["family"])))
        single, whole = all_["single"], all_["whole"]

        def told(near: Column) -> Column:
            def joined(wide: Column) -> Column:
                both = F.concat(F.filter(single, lambda x: (x["family"] != OTHER) | ~F.exists(wide, lambda p: inside(x, p))), wide)
                return F.concat(both, F.filter(whole, lambda p: (p["family"] == OTHER) & ~F.exists(F.concat(single, near), lambda x: inside(x, p))))

            return bound(F.concat(near, named(whole, F.concat(single, near))), joined)

        return F.array_sort(bound(named(all_["near"], single), told))

    kind = "array<struct<line:int,last:int,family:string,probability:double,confirmed:boolean>>"
    one = lambda ls: F.transform(F.filter(ls, lambda x: x["cue"]), lambda x: F.struct(x["line"].alias("line"), x["line"].alias("last"), x["words"].alias("words")))
    near = lambda ls: F.transform(ls, lambda x: F.struct(x["line"].alias("line"), x["words"].alias("words"), (x["blank"] | ~x["near"]).alias("apart"), x["mark"].alias("holds")))
    whole = lambda ls: F.transform(ls, lambda x: F.struct(x["line"].alias("line"), x["words"].alias("words"), x["blank"].alias("apart"), F.lit(True).alias("holds")))
    cued = lambda ps: F.filter(ps, lambda p: F.concat_ws(" ", p["words"]).rlike(_gate(model.cues)))
    judged_all = lambda ls: bound(F.struct(found(one(ls)).alias("single"), found(cued(bound(near(ls), _paragraphs))).alias("near"), found(cued(bound(whole(ls), _paragraphs))).alias("whole")), merged)
    notices = F.when(F.lower(F.col(text)).rlike(_gate(model.cues)), bound(_lines(F.col(text), model), judged_all))
    return docs.drop("notices").withColumn("notices", F.coalesce(notices.cast(kind), F.array().cast(kind)))
