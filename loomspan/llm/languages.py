"""Languages of documents and of their segments by rank-order profiles.

A profile lists the ``PROFILE`` most frequent n-grams (1 to 3 letters, word borders included) of a
language in order. A text's own n-grams are ranked by frequency; the out-of-place distance
adds up how far each stands from its place in the profile, at most ``PROFILE`` for an absent one.
The nearest profile names the language; the confidence is the relative gap to the second.

Profiles are fitted on a bounded sample of labelled rows: ``TRAIN_DOCS`` documents a language
(those with the smallest hash of their id) of at most ``TRAIN_CHARS`` characters, plus the fixed
function words below, so every language has a profile whatever the table holds. After a first
fit, sample documents that are nearer to another language than their label are left out and the
profiles are fitted again. Everything else covers all documents and whole texts.

A document is cut into sentences, after their terminators and closing quotes. Each sentence that
could be a whole one (it ends like a sentence, has some letters and isn't a command, path or table
row) is a segment with its own language; its language counts as contained if it is clearly nearer
than the document's, the more clearly the shorter the sentence is.

Results for odd input: NULL, empty and letterless texts have no language and no rows; unknown,
blank and NULL labels are ``missing``; a label of a language without profile is ``wrong`` if the text
is surely (``OTHER_SURE``) in one that has a profile, and is trusted else; equal distances go to the first language in alphabetical order; repeated rows give equal rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrays import LETTER, SPACE, blocks, char_classes, owners

LANGS = ("de", "en", "es", "fr", "ja", "pt", "ru", "zh")
PROFILE = 400
TRAIN_DOCS = 300
TRAIN_CHARS = 20_000
#: A segment counts as another language if its distance is lower by this part of the profile's length per n-gram.
GAP = 0.02
#: Letters of a sentence from which that gap counts, by whether its script writes syllables or words
#: with one sign. A shorter sentence needs a gap larger by the square of what it lacks, and some letters.
FULL_LETTERS, FULL_SIGNS = 16, 7
MIN_LETTERS, MIN_SIGNS = 10, 4
#: A label of a language without profile is ``wrong`` only if the text's own one is this sure.
OTHER_SURE = 0.5

# Frequent function words of each language.
FUNCTION_WORDS = {
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei wenn ohne weil damit",
    "en": "the of and to in a is that for it was on are as with his they be at one have this from or had by but what some we can out other were all there when up use your how said an each she which do their time if will way about many then them would so no because while after",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque qué sólo han yo hay vez puede todos así nos ni cada",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec son cette aux ou ses mais comme nous sa fait été aussi leur bien peut ces y deux sans entre même quand depuis tout après tous lorsque chaque dès pendant",
    "ja": "の に は を た が で て と し れ さ ある いる も する から な こと として い や れる など なっ ない この ため その あっ よう また もの という あり まで られ なる へ か だ これ によって により おり より による ず なり られる において ば なかっ なく しかし について",
    "pt": "de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou ser quando muito há nos já está eu também só pelo pela até isso ela entre era depois sem mesmo aos ter seus quem nas me esse eles estão você durante cada",
    "ru": "и в не на я быть он с что а по это она этот к но они мы весь который из у то за свой весь год от так о для ты же все тот мочь вы человек такой его сказать один когда если только уже бы до при или как со после без потому через каждый во время чтобы пока",
    "zh": "的 一 是 在 不 了 有 和 人 这 中 大 为 上 个 国 我 以 要 他 时 来 用 们 生 到 作 地 于 出 就 分 对 成 会 可 主 发 年 动 同 工 也 能 下 过 子 说 产 种 面 而 方 后 多 定 行 学 法 所 民 得 经 十 三 之 进 着 等 部 度 家 电 力 里 如 水 化 高 自 二 理 起 小 物 现 实 加 量 都 两 体 制 机 当 使 点 从 业 本 去 把 性 好 应 开 它 合 还 因 由 其 些 然 前 外 天 政 四 日 那 社 义 事 平 形 相 全 表 间 样 与 关 各 重 新 线 内 数 正 心 反 你 明 看 原 又 么 利 比 或 但 质 气 第 向 道 命 此 变 条 只 没 结 解 问 意 建 月 公 无 系 军 很 情 者 最 立 代 想 已 通 并 提 直 题 党 程 展",
}
# Names and codes of the languages, and marks of an unknown one.
LABELS = {
    "de": "de deu ger german deutsch", "en": "en eng english", "es": "es spa spanish español castilian", "fr": "fr fra fre french français",
    "ja": "ja jpn jp japanese", "pt": "pt por portuguese português", "ru": "ru rus russian", "zh": "zh zho chi cmn chinese mandarin cn",
}
UNKNOWN = ("", "und", "unknown", "n/a", "na", "none", "null", "nil", "nan", "?", "??", "-", "--", "xx", "zxx", "mul", "mis", "undetermined", "undefined", "unk", "other", "auto", "not known", "unspecified", "n.a.", "tbd")


def label_language(lang: Column) -> Column:
    """The language a label names: one of ``LANGS``, ``other``, or NULL if it names none."""
    plain = F.lower(F.regexp_replace(lang, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    head = F.regexp_extract(plain, r"^([\p{L}]+)", 1)
    named = F.coalesce(*[F.when(head.isin(words.split()), F.lit(code)) for code, words in LABELS.items()])
    return F.when(lang.isNull() | plain.isin(*UNKNOWN) | (head == "") | head.isin("und", "unknown", "undetermined", "zxx", "mul", "mis"), None).otherwise(F.coalesce(named, F.lit("other")))


_ENDS = np.array([ord(c) for c in ".!?…"], np.uint32)
_FULL_ENDS = np.array([ord(c) for c in "。！？｡"], np.uint32)
_LINE = np.array([10, 13, 0x85, 0x2028, 0x2029], np.uint32)
_CLOSE = np.array([ord(c) for c in "\"'”’»›」』)）"], np.uint32)
_CODE = np.array([ord(c) for c in "{}<>=|_\\"], np.uint32)


@cache
def _lower() -> np.ndarray:
    """Lower case of each code point that has one of a single code point."""
    table = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x20000):
        small = chr(c).lower()
        if len(small) == 1:
            table[c] = ord(small)
    return table


def sentence_ids(cp: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of the sentence of each code point; sentences end within a text and after terminators or lines."""
    n = len(cp)
    cut = np.zeros(n + 1, bool)
    line = np.isin(cp, _LINE)
    full = np.isin(cp, _FULL_ENDS)
    dot = np.isin(cp, _ENDS)
    close = np.isin(cp, _CLOSE)
    quoted = np.zeros(n, bool)  # closing signs right after a terminator
    quoted[1:] = close[1:] & (dot | full)[:-1]
    closed = np.zeros(n, bool)  # terminators that a closing sign follows
    closed[:-1] = quoted[1:]
    space_next = np.ones(n, bool)
    space_next[:-1] = char_classes()[cp[1:]] == SPACE
    wide = np.zeros(n, bool)
    wide[1:] = full[:-1]
    cut[1:] = line | (full & ~closed) | (dot & space_next) | (quoted & (space_next | wide))
    cut[offsets[:-1]] = True
    return np.cumsum(cut[:n]) - 1


def grams(cp: np.ndarray, sid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, sentence) of each 1- to 3-gram in lower case; other signs than letters are a blank, runs one blank."""
    letter = char_classes()[cp] == LETTER
    before = np.zeros(len(cp), bool)
    before[1:] = letter[:-1]
    ahead = np.zeros(len(cp), bool)
    ahead[:-1] = letter[1:]
    first = np.ones(len(cp), bool)
    first[1:] = sid[1:] != sid[:-1]
    keep = letter | before | (first & ahead)
    c = np.where(letter, _lower()[cp], 0x20)[keep].astype(np.uint64)
    s = sid[keep]
    blank = c == 0x20
    codes, where = [c[~blank]], [s[~blank]]
    if len(c) > 1:
        two = (s[1:] == s[:-1]) & ~(blank[1:] & blank[:-1])
        codes.append(((c[:-1] << np.uint64(21)) | c[1:])[two])
        where.append(s[1:][two])
    if len(c) > 2:
        three = (s[2:] == s[:-2]) & ~blank[1:-1]
        codes.append(((c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:])[three])
        where.append(s[2:][three])
    return np.concatenate(codes), np.concatenate(where)


class Profiles:
    """Ranks of the n-grams of all profiles, with a collision-free table to find them."""

    def __init__(self, ordered: dict[str, list[int]], size: int = PROFILE) -> None:
        self.size = size
        self.codes = np.array(sorted({c for codes in ordered.values() for c in codes[:size]}), np.uint64)
        place = {int(c): i for i, c in enumerate(self.codes)}
        self.rank = np.full((len(LANGS), len(self.codes)), size, np.float32)
        for i, lang in enumerate(LANGS):
            for r, c in enumerate(ordered.get(lang, [])[:size]):
                self.rank[i, place[c]] = r
        for odd in range(0x9E3779B97F4A7C15, 0x9E3779B97F4A7C15 + 2000, 2):
            self.odd = np.uint64(odd)
            at = self._slot(self.codes)
            if len(np.unique(at)) == len(at):
                break
        self.table = np.full(1 << 22, -1, np.int32)
        self.table[at] = np.arange(len(self.codes))

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        x = codes * self.odd
        return ((x ^ (x >> np.uint64(31))) * self.odd >> np.uint64(42)).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        at = self.table[self._slot(codes)]
        at[self.codes[at] != codes] = -1
        return at

    def distances(self, unit: np.ndarray, gram: np.ndarray, n: np.ndarray, units: int) -> np.ndarray:
        """Mean out-of-place distance of each unit (rows, sorted by unit) to each language, 0 to 1; 1 if it has no n-gram."""
        out = np.ones((units, len(LANGS)), np.float32)
        if not len(unit):
            return out
        by = np.lexsort((-n, unit))
        u, g, k = unit[by], gram[by], n[by]
        start = np.nonzero(np.concatenate([[True], u[1:] != u[:-1]]))[0]
        tie = np.concatenate([[True], (u[1:] != u[:-1]) | (k[1:] != k[:-1])])
        place = np.arange(len(u)) - np.repeat(start, np.diff(np.append(start, len(u))))
        ties = np.nonzero(tie)[0]
        size = np.diff(np.append(ties, len(u)))
        rank = np.repeat(place[ties] + (size - 1) / 2, size).astype(np.float32)
        count = np.diff(np.append(start, len(u)))
        for i in range(len(LANGS)):
            far = np.minimum(np.abs(rank - self.rank[i, g]), self.size)
            far[self.rank[i, g] >= self.size] = self.size
            out[u[start], i] = np.add.reduceat(far, start) / count / self.size
        return out


def _tally(unit: np.ndarray, gram: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key = unit.astype(np.int64) << 20 | gram
    if weight is None:
        k, n = np.unique(key, return_counts=True)
    else:
        k, back = np.unique(key, return_inverse=True)
        n = np.bincount(back, weights=weight).astype(np.int64)
    return k >> 20, k & ((1 << 20) - 1), n


def count_grams(texts: list[str]) -> Counter:
    total: Counter = Counter()
    for _, _, cp, offsets in blocks(texts):
        codes, _ = grams(cp, sentence_ids(cp, offsets))
        k, n = np.unique(codes, return_counts=True)
        total.update(dict(zip(k.tolist(), n.tolist())))
    return total


def fit_profiles(samples: dict[str, list[str]], size: int = PROFILE) -> Profiles:
    """Profiles of labelled texts and function words, fitted twice: the second time without texts that are nearer to another language."""

    def fit(chosen: dict[str, list[str]]) -> Profiles:
        ordered = {}
        for lang in LANGS:
            counts = count_grams(chosen.get(lang, []))
            total = sum(counts.values())
            seed = count_grams([FUNCTION_WORDS[lang]])
            share = max(1.0, 0.02 * total / max(1, sum(seed.values())))
            for c, n in seed.items():
                counts[c] += share * n
            ordered[lang] = [c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size]]
        return Profiles(ordered, size)

    first = fit(samples)
    pure = {}
    for lang, texts in samples.items():
        near = document_distances(texts, first).argmin(axis=1)
        pure[lang] = [t for t, i in zip(texts, near) if LANGS[i] == lang]
    return fit(pure)


def document_distances(texts: list[str], profiles: Profiles) -> np.ndarray:
    out = np.ones((len(texts), len(LANGS)), np.float32)
    for lo, hi, cp, offsets in blocks(texts):
        codes, sid = grams(cp, sentence_ids(cp, offsets))
        at = profiles.find(codes)
        doc = owners(offsets)[np.searchsorted(sentence_ids(cp, offsets), sid)] if len(sid) else sid
        ok = at >= 0
        out[lo:hi] = profiles.distances(*_tally(doc[ok], at[ok]), hi - lo)
    return out


class Segmented:
    """Languages of the documents and sentences of one block."""

    def __init__(self, cp: np.ndarray, offsets: np.ndarray, profiles: Profiles) -> None:
        docs = len(offsets) - 1
        self.sid = sentence_ids(cp, offsets)
        units = int(self.sid[-1]) + 1 if len(cp) else 0
        kind = char_classes()[cp]
        self.start = np.searchsorted(self.sid, np.arange(units))
        self.end = np.append(self.start[1:], len(cp))
        self.doc = owners(offsets)[self.start] if units else np.zeros(0, np.int64)
        codes, sid = grams(cp, self.sid)
        at = profiles.find(codes)
        ok = at >= 0
        unit, gram, n = _tally(sid[ok], at[ok])
        self.far = profiles.distances(unit, gram, n, units)
        self.doc_far = profiles.distances(*_tally(self.doc[unit], gram, n), docs)
        self.letters = np.bincount(self.sid[kind == LETTER], minlength=units)
        signs = (kind == LETTER) & (((cp >= 0x3040) & (cp < 0xA000)) | ((cp >= 0xAC00) & (cp < 0xD7B0)) | (cp >= 0x20000))
        self.signs = np.bincount(self.sid[signs], minlength=units)
        self.doc_letters = np.bincount(self.doc, weights=self.letters, minlength=docs) if units else np.zeros(docs)
        goes_on = np.zeros(len(cp), bool)
        goes_on[:-1] = (self.sid[1:] == self.sid[:-1]) & (kind[1:] != SPACE) & ~np.isin(cp[1:], _CLOSE)
        ends = (np.isin(cp, _ENDS) & ~goes_on) | np.isin(cp, _FULL_ENDS)
        self.whole = np.bincount(self.sid[ends], minlength=units) > 0
        self.whole &= (self.letters >= MIN_LETTERS) | (self.signs >= MIN_SIGNS)
        self.full = np.minimum(1.0, np.maximum(self.letters / FULL_LETTERS, self.signs / FULL_SIGNS))
        self.whole &= np.bincount(self.sid[np.isin(cp, _CODE)], minlength=units) == 0
        letters = np.nonzero(kind == LETTER)[0]
        if len(letters):
            first = letters[np.minimum(np.searchsorted(letters, self.start), len(letters) - 1)]
            small = (_lower()[cp[first]] == cp[first]) & (cp[first] < 0x530) & (cp[first] != 0xAA)
            self.whole &= ~small


def languages_of(cp: np.ndarray, offsets: np.ndarray, profiles: Profiles, gap: float = GAP):
    """(the Segmented block, main language of each document or -1, contained languages as a documents x languages array, language of each sentence)."""
    x = Segmented(cp, offsets, profiles)
    docs = len(offsets) - 1
    near = x.far.argmin(axis=1) if len(x.far) else np.zeros(0, np.int64)
    main = np.where(x.doc_letters > 0, x.doc_far.argmin(axis=1), -1)
    held = np.zeros((docs, len(LANGS)), bool)
    has = main >= 0
    held[np.nonzero(has)[0], main[has]] = True
    if len(near):
        own = main[x.doc]
        lead = x.far[np.arange(len(near)), np.maximum(own, 0)] - x.far[np.arange(len(near)), near]
        foreign = x.whole & (own >= 0) & (near != own) & (lead * x.full**2 >= gap)
        held[x.doc[foreign], near[foreign]] = True
        x.foreign = foreign
    else:
        x.foreign = np.zeros(0, bool)
    return x, main, held, near


def _confidence(far: np.ndarray) -> np.ndarray:
    best = np.sort(far, axis=1)
    return np.clip((best[:, 1] - best[:, 0]) / np.maximum(best[:, 1], 1e-6) * 4, 0, 1)


def _documents(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = shared.value
        for batch in batches:
            for lo, hi, cp, offsets in blocks([t or "" for t in batch.column(1).to_pylist()]):
                x, main, held, _ = languages_of(cp, offsets, profiles)
                sure = _confidence(x.doc_far)
                names = [[LANGS[i] for i in np.nonzero(h)[0]] for h in held]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array([LANGS[m] if m >= 0 else None for m in main], pa.string()), pa.array(names, pa.list_(pa.string())), pa.array(sure, pa.float64()), batch.column(2).slice(lo, hi - lo)],
                    names=["doc_id", "language", "languages", "confidence", "label"],
                )

    return run


def _segments(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = shared.value
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, cp, offsets in blocks([t or "" for t in batch.column(1).to_pylist()]):
                x, main, held, near = languages_of(cp, offsets, profiles)
                lang = np.where(x.foreign, near, main[x.doc]) if len(near) else near
                if not len(lang):
                    continue
                fresh = np.concatenate([[True], (lang[1:] != lang[:-1]) | (x.doc[1:] != x.doc[:-1])])
                first = np.nonzero(fresh)[0]
                last = np.append(first[1:], len(lang)) - 1
                ok = (lang[first] >= 0) & (np.add.reduceat(x.letters, first) > 0)
                first, last = first[ok], last[ok]
                seg = np.cumsum(fresh)
                weight = np.maximum(x.letters, 1)
                mean = np.add.reduceat(x.far * weight[:, None], np.nonzero(fresh)[0]) / np.add.reduceat(weight, np.nonzero(fresh)[0])[:, None]
                sure = _confidence(mean)[seg[first] - 1]
                doc = x.doc[first]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(lo + doc)), pa.array(x.start[first] - offsets[doc], pa.int32()), pa.array(x.end[last] - offsets[doc], pa.int32()), pa.array([LANGS[i] for i in lang[first]], pa.string()), pa.array(sure, pa.float64())],
                    names=["doc_id", "start", "end", "language", "confidence"],
                )

    return run


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Profiles:
    """Profiles of the labelled sample of ``docs`` (see the module's text for its bounds)."""
    rows = docs.where(F.col(text).isNotNull() & (F.length(text) <= TRAIN_CHARS))
    coded = rows.select(F.col(doc_id).alias("doc_id"), label_language(F.col(lang)).alias("code")).where(F.col("code").isin(*LANGS))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    share = {r["code"]: min(1.0, 4 * TRAIN_DOCS / r["n"]) for r in coded.groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    limit = F.coalesce(*[F.when(F.col("code") == c, F.lit(int(x * (1 << 40)))) for c, x in share.items()], F.lit(0))
    by = W.partitionBy("code").orderBy(part, "doc_id")  # over some TRAIN_DOCS * 4 rows a language
    chosen = coded.where(part < limit).withColumn("r", F.row_number().over(by)).where(F.col("r") <= TRAIN_DOCS).select("doc_id", "code")
    ids = chosen.collect()  # at most TRAIN_DOCS a language
    code = {r["doc_id"]: r["code"] for r in ids}
    if not code:
        return fit_profiles({})
    samples: dict[str, list[str]] = {}
    seen = set()
    for r in rows.where(F.col(doc_id).isin(list(code))).select(doc_id, text).collect():
        if r[0] not in seen:
            seen.add(r[0])
            samples.setdefault(code[r[0]], []).append(r[1])
    return fit_profiles(samples)


def document_languages(docs: DataFrame, profiles: Profiles | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, language, languages (all contained), confidence, label of every row; NULL language where the text has no letters."""
    profiles = profiles or train(docs, doc_id, text, lang)
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_documents(shared), f"doc_id {kind}, language string, languages array<string>, confidence double, label string")


def language_segments(docs: DataFrame, profiles: Profiles | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, start, end, language, confidence of each stretch of one language, offsets in code points."""
    profiles = profiles or train(docs, doc_id, text, lang)
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_segments(shared), f"doc_id {kind}, start int, end int, language string, confidence double")


def label_defects(languages: DataFrame) -> DataFrame:
    """doc_id, defect (``mixed``, ``missing``, ``wrong``), lang of documents whose label is no good."""
    rows = languages.where("language IS NOT NULL").withColumn("named", label_language(F.col("label")))
    mixed = F.size("languages") > 1
    unsure = (F.col("named") == "other") & (F.col("confidence") < OTHER_SURE)
    defect = F.when(mixed, "mixed").when(F.col("named").isNull(), "missing").when((F.col("named") != F.col("language")) & ~unsure, "wrong")
    return rows.select("doc_id", defect.alias("defect"), F.explode("languages").alias("lang")).where("defect IS NOT NULL").distinct()
