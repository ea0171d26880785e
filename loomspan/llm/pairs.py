"""Defective question and answer pairs.

A multi-label linear classifier decides for each pair whether its answer is empty, truncated, a
refusal, a copy of the question or in another language. It reads hashed n-grams of the question, of
the answer, of its end and of short answers, and pair features: how the answer ends, open code
blocks, what remains once the question is taken out, the distances of both sides to language
profiles, and how much each sentence is like a refusal, which a linear model over hashed n-grams of
sentences says. Features are measures and their products; what they mean is learned.

Both models are fitted on synthetic defects: a bounded sample of pairs (``SAMPLE`` rows, those with the
smallest hash) gives clean pairs, which are cut off, swapped between languages, replaced by refusals,
placeholders or their question, or varied without becoming defective. A threshold per defect is
calibrated for the best F1 on a held-out part. Every pair of the tables is then classified, in
Arrow batches. Of several defects over their thresholds the clearest counts.

Results for odd input: a NULL answer is ``empty`` whatever the question; a NULL or blank question
can't be copied and names no language; repeated rows come out once; in empty tables, or where too few clean pairs
are there to learn from, the fixed phrases alone are used for fitting.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import languages as L
from .arrays import blocks, owners, rolling
from .pair_phrases import ASKED, CLOSINGS, HEDGES, ORDINARY, PLACEHOLDERS, REFUSALS

DEFECTS = ("empty", "truncated", "refusal", "copy", "language")
SAMPLE = 6000
#: Distinct sentences of the sample's answers, and of its questions, at most, that the sentence model is fitted on.
CONTENT_SENTENCES, QUESTION_SENTENCES = 2600, 300
SEED = 5
#: Hashed n-grams of a pair: of the answer's end, of the answer as far as it is short, of the whole answer and of the question.
GRAM_DIMS, SENTENCE_DIMS = (256, 256, 512, 256), 4096

_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_CITE = re.compile(r"(?:\s*(?:\[\d+\]|【\d+】|\(\d+\)))+\s*$")
_WRAP = re.compile(r"^[\s>*_\"'“”„«»‘’「」『』()（）\[\]`#-]+|[\s*_\"'“”„«»‘’「」『』()（）\[\]`]+$")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？｡])\s*|\n+")
_SPEAKER = re.compile(r"^[^\n:：.。!?]{1,40}[:：]\s*")
_PLAIN = re.compile(r"[\W_]+")
_VALUE = re.compile(r"^[\w.+/%°$€:=-]*\d[\w.+/%°$€:=-]*(?:\s*[%\w°]{1,6})?$")
_ENDS = "。！？｡.!?"
_ASK = re.compile("|".join(sorted((re.escape(w) for ws in ASKED.values() for w in ws.split()), key=len, reverse=True)))
_ASKED = {w: lang for lang, ws in ASKED.items() for w in ws.split()}
_IN = re.compile(r"answer|respond|reply|write|antwort|répon|respond|respuest|ответ|回答|答|答え|返答", re.I)


def plain(text: str) -> str:
    return _PLAIN.sub("", text.casefold())


def asked_language(question: str) -> str | None:
    """The language a question asks to be answered in."""
    last = [s for s in re.split(r"(?<=[.!?。？！])\s*", question) if s.strip()]
    for s in last[1:]:
        if _IN.search(s) and (m := _ASK.search(s.casefold())):
            return _ASKED[m.group()]
    return None


def body(answer: str) -> str:
    """The answer without code blocks and citations at its end."""
    return _CITE.sub("", _FENCE.sub(" ", answer)).strip()


def sentences(answer: str) -> list[str]:
    """Sentences as the refusal model reads them: lower case, without marks around them."""
    out = []
    for s in _SENTENCE.split(body(answer)):
        s = _WRAP.sub("", _CITE.sub("", s)).strip().casefold()
        if len(plain(s)) > 1:
            out.append(s)
    return out


def gram_matrix(texts: list[str], sizes: tuple[int, ...], dims: int, salt: int = 0) -> np.ndarray:
    """Counts of the hashed n-grams of each text, its borders included, as rows of length 1 of their square roots."""
    out = np.zeros((len(texts), dims), np.float32)
    for lo, hi, cp, offsets in blocks([f"\x02{t}\x03" for t in texts], 1 << 18):
        owner, end = owners(offsets), np.repeat(offsets[1:], np.diff(offsets))
        total = np.zeros((hi - lo) * dims)
        for n in sizes:
            h = rolling(cp, n)
            at = np.nonzero(np.arange(len(h)) + n <= end[: len(h)])[0]
            total += np.bincount(owner[at] * dims + ((h[at] + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % dims, minlength=len(total))
        out[lo:hi] = np.sqrt(total).reshape(hi - lo, dims)
    return out / np.maximum(1e-6, np.linalg.norm(out, axis=1, keepdims=True))


_DIGITS = re.compile(r"\d+")


def sentence_matrix(rows: list[str]) -> np.ndarray:
    grams = gram_matrix([_DIGITS.sub("0", s) for s in rows], (2, 3, 4), SENTENCE_DIMS)
    return np.concatenate([grams, np.ones((len(rows), 1), np.float32)], axis=1)


def said_of(rows: list[str], model: Linear) -> np.ndarray:
    """(refusal, closing) of each sentence, the larger of with and without a speaker before it."""
    bare = [_SPEAKER.sub("", s) or s for s in rows]
    at = [i for i, (a, b) in enumerate(zip(rows, bare)) if a != b]
    everything = rows + [bare[i] for i in at]
    p = np.concatenate([model.probability(sentence_matrix(everything[lo : lo + 2000])) for lo in range(0, len(everything), 2000)]) if rows else np.zeros((0, 2))
    out = p[: len(rows)].copy()
    out[at] = np.maximum(out[at], p[len(rows) :])
    return out


class Linear:
    """One-against-rest logistic regression by Adam on the whole batch."""

    def __init__(self, rounds: int = 250, rate: float = 0.1, decay: float = 1e-4, floor: float = 0.25) -> None:
        self.rounds, self.rate, self.decay, self.floor = rounds, rate, decay, floor

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Linear:
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), self.floor)  # rare n-grams aren't blown up
        self.mean[-1], self.scale[-1] = 0, 1
        z = ((x - self.mean) / self.scale).astype(np.float32)
        w = np.zeros((x.shape[1], y.shape[1]), np.float32)
        m, v = np.zeros_like(w), np.zeros_like(w)
        k = np.ones((len(y), 1), np.float32) if weight is None else weight.astype(np.float32)
        k = k / k.mean()
        for t in range(1, self.rounds + 1):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            g = z.T @ ((p - y) * k) / len(y) + self.decay * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= self.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.w = w
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(((x - self.mean) / self.scale) @ self.w, -30, 30)))


@dataclass
class PairModel:
    profiles: L.Profiles
    sentence: Linear
    pair: Linear
    thresholds: np.ndarray


def _remainder(q: str, a: str) -> tuple[float, float, float]:
    """(share of the question in the answer, what else is in the answer by the question's length, whether it begins with the question)."""
    p, r = plain(q), plain(a)
    if not p or not r:
        return 0.0, 1.0, 0.0
    if p in r:
        return 1.0, len(r.replace(p, "")) / len(p), float(r.startswith(p))
    if r in p:
        return len(r) / len(p), 0.0, 0.0
    grams = {p[i : i + 4] for i in range(max(1, len(p) - 3))}
    mine = [r[i : i + 4] for i in range(max(1, len(r) - 3))]
    both = sum(g in grams for g in mine)
    return min(1.0, len(grams & set(mine)) / len(grams)), (len(mine) - both) / len(p), 0.0


def pair_matrix(pairs: list[tuple[str | None, str | None]], profiles: L.Profiles, sentence: Linear) -> np.ndarray:
    """One row a pair: pair features, hashed n-grams, 1."""
    qs, answers = [q or "" for q, _ in pairs], [a or "" for _, a in pairs]
    bodies = [body(a) for a in answers]
    cores = [_ASK_SENTENCE(q) for q in qs]
    fq, fa = L.document_distances(cores, profiles), L.document_distances(bodies, profiles)
    split = [sentences(a) for a in answers]
    flat = [s for ss in split for s in ss]
    said = said_of(flat, sentence)
    rows = np.zeros((len(pairs), 35), np.float32)
    at = 0
    for i, (q, a, b) in enumerate(zip(qs, answers, bodies)):
        mine = said[at : at + len(split[i])]
        at += len(split[i])
        letters = plain(a)
        end = _WRAP.sub("", b)
        tail = b.rstrip().rstrip("*_\"'”’»」』)）] ")
        last = tail[-1:]
        fences = a.count("```")
        value = bool(_VALUE.match(_WRAP.sub("", a))) and len(a) < 40
        held, rest, leads = _remainder(q, a)
        lq, la = int(fq[i].argmin()), int(fa[i].argmin())
        asked = asked_language(q)
        allowed = {L.LANGS[lq]} | ({asked} if asked else set())
        known = len(plain(q)) >= 4 and len(plain(b)) >= 8 and not value
        foreign = known and L.LANGS[la] not in allowed
        gap = float(min(fa[i][L.LANGS.index(x)] for x in allowed) - fa[i].min()) if known else 0.0
        dots = bool(re.search(r"(?:\.\.\.|…)\s*$", tail or a)) or a.rstrip().endswith(("...", "…"))
        open_code = fences % 2 == 1
        ended = last in _ENDS and bool(last) and not dots
        copied = held**4 * max(0.0, 1 - rest / 0.7)
        every = mine.max(axis=1) if len(mine) else np.zeros(0)
        refused = float(mine[:, 0].max()) if len(mine) else 0.0
        least = float(every.min()) if len(mine) else 0.0
        declines = refused * least
        short = len(letters) <= 12
        blank = not letters
        rows[i, :35] = (
            blank, short, len(letters) == 0 and len(a) > 0, min(len(letters), 400) / 100, np.log1p(len(letters)), value, open_code, ended, dots, fences >= 2 and not open_code and a.rstrip().endswith("```"),
            last in "，,、;；:：" and bool(last), bool(last) and last.isalnum(), a != a.rstrip(), held, min(rest, 3), leads, copied, held**4 * min(1.0, rest / 0.7), foreign, gap * foreign, min(gap, 0.5),
            refused, least, declines, float(every.mean()) if len(mine) else 0, refused * (1 - least), len(mine), (not (ended or value or open_code or blank)) * (1 - copied) * (1 - declines),
            declines**4, 4 * declines * (1 - declines), (not ended) * declines, dots and not blank, known, asked is not None, bool(end) and end[-1:].isdigit(),
        )
    folded = [a.strip().casefold() for a in answers]
    grams = [gram_matrix(texts, sizes, dims, k) for k, (texts, sizes, dims) in enumerate(zip(([a[-4:] for a in folded], [a if len(a) <= 16 else "" for a in folded], folded, [q.strip().casefold() for q in qs]), ((1, 2), (1, 2, 3), (2, 3), (2, 3)), GRAM_DIMS))]
    return np.concatenate([rows, *grams, np.ones((len(pairs), 1), np.float32)], axis=1)


def _ASK_SENTENCE(question: str) -> str:
    """A question without the sentence that asks for a language."""
    parts = [s for s in re.split(r"(?<=[.!?。？！])\s*", question) if s.strip()]
    return " ".join(s for i, s in enumerate(parts) if i == 0 or not (_IN.search(s) and _ASK.search(s.casefold())))


# Fitting


def rough_language(text: str) -> str | None:
    """Language by script and function words; None if that isn't clear."""
    kana = sum("぀" <= c <= "ヿ" for c in text)
    han = sum("一" <= c <= "鿿" for c in text)
    cyr = sum("Ѐ" <= c <= "ӿ" for c in text)
    letters = sum(c.isalpha() for c in text)
    if letters < 4:
        return None
    if kana > 2:
        return "ja"
    if han > 0.3 * letters:
        return "zh"
    if cyr > 0.3 * letters:
        return "ru"
    words = re.findall(r"[^\W\d_]+", text.lower())
    hits = sorted(((sum(w in _FUNCTION[x] for w in words), x) for x in ("de", "en", "es", "fr", "pt")), reverse=True)
    return hits[0][1] if hits[0][0] > hits[1][0] else None


_FUNCTION = {x: frozenset(ws.split()) for x, ws in L.FUNCTION_WORDS.items()}


def clean_pairs(pairs: list[tuple[str | None, str | None]]) -> list[tuple[str, str, str]]:
    """(question, answer, language) of the pairs that show no defect at first sight."""
    out = []
    for q, a in pairs:
        if not q or not a or len(a) < 20 or a.count("```") % 2 or asked_language(q):
            continue
        b = body(a)
        lang = rough_language(q)
        if not b or b[-1] not in _ENDS or b.endswith("...") or lang is None or rough_language(b) != lang:
            continue
        held, _, _ = _remainder(q, a)
        if held > 0.7:
            continue
        out.append((q, a, lang))
    return out


def _fallback() -> list[tuple[str, str, str]]:
    """Clean pairs from fixed phrases, where a table has too few."""
    return [(c if c[-1] in "?？" else c[:-1] + "?", " ".join(L.FUNCTION_WORDS[x].split()[k : k + 12]).capitalize() + ("。" if x in ("ja", "zh") else "."), x) for x in L.LANGS for c in CLOSINGS[x] for k in (0, 9, 20)]


def _refusal(r: random.Random, lang: str) -> str:
    s = r.choice(REFUSALS[lang])
    gap = "" if lang in ("ja", "zh") else " "
    if r.random() < 0.25:
        s += gap + r.choice(REFUSALS[lang])
    if r.random() < 0.3:
        s += gap + r.choice(CLOSINGS[lang])
    x = r.random()
    return f"**{s.rstrip('.。')}**" if x < 0.08 else f"**{s}**" if x < 0.16 else s.upper() if x < 0.24 else f"Bot: {s}" if x < 0.28 else f"> {s}" if x < 0.32 else s.rstrip(".。") if x < 0.4 else s


def synthesise(clean: list[tuple[str, str, str]], seed: int = SEED) -> tuple[list[tuple[str | None, str | None]], np.ndarray]:
    """Pairs with their labels (columns as ``DEFECTS``)."""
    r = random.Random(seed)
    by_lang: dict[str, list[str]] = {}
    for _, a, lang in clean:
        by_lang.setdefault(lang, []).append(a)
    langs = sorted(by_lang)
    rows: list[tuple[str | None, str | None]] = []
    labels: list[int | None] = []

    def add(q: str | None, a: str | None, defect: str | None) -> None:
        rows.append((q, a))
        labels.append(None if defect is None else DEFECTS.index(defect))

    code = ["```\nrun --depth 3\n```", "```json\n{\"a\": 1, \"b\": [2]}\n```", "```python\nx = f(3)\nprint(x)\n```", "```\nGET /api/items/3\n```"]
    for q, a, lang in clean:
        gap = "" if lang in ("ja", "zh") else " "
        add(q, a, None)
        x = r.random()
        if x < 0.3:
            add(q, a + r.choice(["", " "]) + "".join(f"[{r.randint(1, 9)}]" for _ in range(r.randint(1, 2))), None)
        elif x < 0.5:
            add(q, f"{a}\n{r.choice(code)}", None)
        elif x < 0.65:
            add(q, r.choice([str(r.randint(1, 9999)), f"{r.randint(1, 99)} %", f"20{r.randint(10, 30)}-0{r.randint(1, 9)}-{r.randint(10, 28)}", f"v{r.randint(0, 9)}.{r.randint(0, 9)}.{r.randint(0, 9)}", f"size={r.randint(1, 900)}", f"{r.randint(1, 99)} ms", f"{r.randint(1, 23)}:{r.randint(10, 59)}"]), None)
        elif x < 0.8:
            add(q, r.choice(HEDGES[lang]) + gap + a, None)
        elif x < 0.9:
            add(q, q + gap + a, None)
        elif len(langs) > 1:
            other = r.choice([x for x in langs if x != lang])
            asks = {"en": "Please answer in {}.", "zh": "请用{}回答。", "de": "Bitte antworte auf {}.", "fr": "Répondez en {}.", "es": "Responde en {}.", "pt": "Responda em {}.", "ru": "Ответьте на {}.", "ja": "{}で回答してください。"}[lang]
            names = [w for w in ASKED[other].split() if rough_language(w * 3) == lang or lang not in ("zh", "ja", "ru")]
            add(q + gap + asks.format(r.choice(names or ASKED[other].split()).capitalize()), r.choice(by_lang[other]), None)
        x = r.random()
        if x < 0.45:
            b = body(a)
            starts = [0, *(m.end() for m in _SENTENCE.finditer(b) if m.end() < len(b) - 6)]
            lo, hi = starts[-1] + 3, len(b) - 2
            if hi > lo:
                cut = b[: r.randint(lo, hi)]
                if cut.rstrip()[-1:] not in _ENDS:
                    add(q, cut + r.choice(["", "", "", "…", "...", ",", "，", " ", " "]), "truncated")
        elif x < 0.6:
            block = r.choice(code)
            add(q, f"{a}\n{block[: r.randint(6, len(block) - 4)]}", "truncated")
        elif x < 0.75:
            p = r.choice([q, q, q.rstrip("?？. "), f'"{q}"', f"> {q}\n\n{q}", q + gap + q, q.upper(), q.rstrip("?？") + "??", f"  {q}\n", q.rstrip("?？") + ("。" if gap == "" else "."), f"**{q}**"])
            add(q, p, "copy")
        elif x < 0.88 and len(langs) > 1:
            add(q, r.choice(by_lang[r.choice([y for y in langs if y != lang])]), "language")
        if r.random() < 0.25:
            add(q, _refusal(r, lang), "refusal")
        if r.random() < 0.12:
            add(q, None if r.random() < 0.2 else r.choice(PLACEHOLDERS), "empty")
    y = np.zeros((len(rows), len(DEFECTS)), np.float32)
    for i, k in enumerate(labels):
        if k is not None:
            y[i, k] = 1
    return rows, y


def fit_sentences(clean: list[tuple[str, str, str]]) -> Linear:
    """Columns: refusal, closing. The sample's sentences are content (at most ``CONTENT_SENTENCES`` of answers and ``QUESTION_SENTENCES`` of questions, chosen at random); those that look like refusals are left out of a second fit."""
    r = random.Random(SEED)
    texts = [s for x in L.LANGS for p in REFUSALS[x] for s in sentences(p)]
    ends = [s for x in L.LANGS for p in CLOSINGS[x] for s in sentences(p)]
    hedges = [s for x in L.LANGS for p in HEDGES[x] + ORDINARY[x] for s in sentences(p)]
    # A sentence that recurs, as refusals do, is one example, with whatever speaker.
    bare = lambda s: _SPEAKER.sub("", s) or s
    content = sorted({bare(s) for _, a, _ in clean for s in sentences(a)})
    questions = sorted({bare(s) for q, _, _ in clean for s in sentences(q)})
    r.shuffle(content)
    r.shuffle(questions)
    content = content[:CONTENT_SENTENCES] + questions[:QUESTION_SENTENCES]

    fixed = sentence_matrix([*texts, *ends, *hedges])
    rows = sentence_matrix(content)

    def fit(at: np.ndarray, rounds: int, decay: float) -> Linear:
        y = np.zeros((len(fixed) + len(at), 2), np.float32)
        y[: len(texts), 0] = 1
        y[len(texts) : len(texts) + len(ends), 1] = 1
        weight = np.ones((len(y), 1))
        weight[: len(fixed)] = max(1.0, 0.5 * len(at) / max(1, len(texts)))
        return Linear(rounds=rounds, rate=0.05, decay=decay, floor=0.05).fit(np.concatenate([fixed, rows[at]]), y, weight)

    # The sample holds refusals too: what a model of the other folds takes for one is no content.
    kept = np.arange(len(content))
    for limit in (0.35, 0.2):
        folds = [kept[k::3] for k in range(3)]
        others = [np.concatenate([f for j, f in enumerate(folds) if j != k]) for k in range(3)]
        kept = np.sort(np.concatenate([f[fit(o, 120, 1e-3).probability(rows[f])[:, 0] < limit] for f, o in zip(folds, others)]))
    return fit(kept, 240, 3e-4)


def _declines(answers: list[str], sentence: Linear) -> list[bool]:
    """Whether every sentence of an answer declines or closes: such pairs of the sample aren't clean."""
    split = [sentences(a) for a in answers]
    flat = [s for ss in split for s in ss]
    said = said_of(flat, sentence)
    out, at = [], 0
    for ss in split:
        mine = said[at : at + len(ss)]
        at += len(ss)
        out.append(bool(len(mine)) and bool((mine.max(axis=1) > 0.4).all()) and bool(mine[:, 0].max() > 0.4))
    return out


def calibrate(p: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each defect the threshold of the best F1, in the middle of those that reach it."""
    grid = np.linspace(0.25, 0.95, 71)
    out = np.full(p.shape[1], 0.5)
    for k in range(p.shape[1]):
        f1 = []
        for t in grid:
            tp = float(((p[:, k] >= t) & (y[:, k] > 0)).sum())
            f1.append(2 * tp / max(1.0, float((p[:, k] >= t).sum() + y[:, k].sum())))
        best = np.nonzero(np.array(f1) >= max(f1) - 1e-9)[0]
        if max(f1) > 0:
            out[k] = grid[best].mean()
    return out


def fit_model(pairs: list[tuple[str | None, str | None]]) -> PairModel:
    clean = clean_pairs(pairs)
    if len(clean) < 200:
        clean = clean + _fallback()
    samples: dict[str, list[str]] = {}
    for q, a, lang in clean:
        samples.setdefault(lang, []).extend((q, body(a)))
    for lang in L.LANGS:
        samples.setdefault(lang, []).extend(REFUSALS[lang] + CLOSINGS[lang] + HEDGES[lang])
    profiles = L.fit_profiles(samples)
    sentence = fit_sentences(clean)
    clean = [c for c, d in zip(clean, _declines([a for _, a, _ in clean], sentence)) if not d]
    rows, y = synthesise(clean)
    x = pair_matrix(rows, profiles, sentence)
    order = np.random.default_rng(SEED).permutation(len(rows))
    train, held = order[: int(len(order) * 0.75)], order[int(len(order) * 0.75) :]
    pair = Linear().fit(x[train], y[train])
    return PairModel(profiles, sentence, pair, calibrate(pair.probability(x[held]), y[held]))


def classify(pairs: list[tuple[str | None, str | None]], model: PairModel) -> list[tuple[str | None, float]]:
    """(defect or None, its probability) of each pair."""
    p = model.pair.probability(pair_matrix(pairs, model.profiles, model.sentence))
    lead = (p - model.thresholds) / (1 - model.thresholds)
    best = lead.argmax(axis=1)
    return [(DEFECTS[k] if lead[i, k] >= 0 else None, float(p[i, k])) for i, k in enumerate(best)]


def all_pairs(golden: DataFrame, results: DataFrame) -> DataFrame:
    """origin, pair_id, question, answer of both tables, once each."""
    a = golden.select(F.lit("golden").alias("origin"), F.col("id").cast("string").alias("pair_id"), F.col("question").cast("string").alias("question"), F.col("golden_answer").cast("string").alias("answer"))
    b = results.select(F.lit("eval").alias("origin"), F.col("result_id").cast("string").alias("pair_id"), F.col("question").cast("string").alias("question"), F.col("answer").cast("string").alias("answer"))
    return a.unionByName(b)


def train(pairs: DataFrame, sample: int = SAMPLE) -> PairModel:
    """A model of at most ``sample`` distinct pairs, those with the smallest hash; rows over a bound on the hash never leave their task."""
    rows = pairs.where("question IS NOT NULL AND answer IS NOT NULL").withColumn("h", F.xxhash64("origin", "pair_id", "answer"))
    share = min(1.0, 4 * sample / max(1, rows.count()))
    some = rows.where(F.pmod("h", F.lit(1 << 40)) < F.lit(int(share * (1 << 40))))
    chosen = some.distinct().orderBy("h", "pair_id").limit(sample)
    return fit_model([(r["question"], r["answer"]) for r in chosen.collect()])


def _classify_batches(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                said = classify(list(zip(part.column(2).to_pylist(), part.column(3).to_pylist())), model)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([d for d, _ in said], pa.string()), pa.array([p for _, p in said], pa.float64())], names=["origin", "pair_id", "defect", "confidence"])

    return run


def pair_defects(pairs: DataFrame, model: PairModel | None = None) -> DataFrame:
    """origin, pair_id, defect (NULL for none), confidence of every pair."""
    shared = pairs.sparkSession.sparkContext.broadcast(model or train(pairs))
    return pairs.mapInArrow(_classify_batches(shared), "origin string, pair_id string, defect string, confidence double")
