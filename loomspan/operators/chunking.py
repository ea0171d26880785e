"""Document chunkers: seven methods by name, keywords and questions.

Every method is a fold over the lines or paragraphs of one row, expressed with higher-order
functions: no shuffle, no Python, and a document of any length stays in its own row. A NULL or
empty document has no chunks; a method that finds no structure falls back to ``general``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import strip, token_count

# Headings that begin a section.
PAPER = ["abstract", "摘要", "introduction", "引言", "绪论", "related work", "相关工作", "methodology", "方法", "方法论", "experiment", "实验", "result", "结果", "discussion", "讨论", "conclusion", "结论", "reference", "参考文献", "acknowledgment", "致谢"]
RESUME = "个人信息 基本信息 personal contact 教育背景 教育经历 education 工作经历 工作经验 experience employment 项目经验 项目经历 project 技能 专业技能 skill 证书 资格证书 certificate 自我评价 summary objective".split()
CHAPTER = r"(?iu)^(第[一二三四五六七八九十百千\d]+[章节部篇]|chapter\s+\d+)"
NO_TITLE = "未命名章节"
NO_SECTION = "未命名"
DEFAULT_QUESTION = "这段内容的主要观点是什么？"

_PIECE = "array<struct<title:string,content:string>>"


def lines_of(text: Column) -> Column:
    return F.transform(F.split(text, "\n", -1), strip)


def naive(text: Column, size: int = 500, overlap: int = 50) -> Column:
    """Slices of ``size`` characters, each beginning ``size - overlap`` after the one before."""
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the size")
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.cast("string").alias("title"), F.substring(text, s + 1, F.lit(size)).alias("content")))


def general(text: Column, size: int = 1000, overlap: bool = True) -> Column:
    """Paragraphs packed up to ``size`` characters; a new chunk begins with the last paragraph of the one before."""
    paragraphs = F.filter(F.transform(F.split(text, "\n\n+", -1), strip), lambda p: p != "")
    start = F.struct(F.array().cast(_PIECE).alias("out"), F.array().cast("array<string>").alias("cur"), F.lit(0).alias("n"))

    def flush(s: Column) -> Column:
        return F.concat(s["out"], F.array(F.struct(F.size(s["cur"]).cast("string").alias("title"), F.array_join(s["cur"], "\n\n").alias("content"))))

    def step(s: Column, p: Column) -> Column:
        full = (F.size(s["cur"]) > 0) & (s["n"] + F.length(p) > size)
        carried = F.slice(s["cur"], -1, 1) if overlap else F.array().cast("array<string>")
        held = F.length(F.element_at(s["cur"], -1)) if overlap else F.lit(0)
        return F.struct(
            F.when(full, flush(s)).otherwise(s["out"]).alias("out"),
            F.when(full, F.concat(carried, F.array(p))).otherwise(F.concat(s["cur"], F.array(p))).alias("cur"),
            F.when(full, held + F.length(p)).otherwise(s["n"] + F.length(p)).alias("n"),
        )

    return F.aggregate(paragraphs, start, step, lambda s: F.when(F.size(s["cur"]) > 0, flush(s)).otherwise(s["out"]))


def sections(text: Column, header: Callable[[Column], Column], least: int, untitled: str, most: int | None = None) -> Column:
    """Runs of lines, each begun by a header; a run of at most ``least`` characters is dropped unless it passed ``most``."""
    start = F.struct(F.array().cast(_PIECE).alias("out"), F.array().cast("array<string>").alias("cur"), F.lit(None).cast("string").alias("title"), F.lit(0).alias("n"))

    def piece(title: Column, cur: Column) -> Column:
        return F.array(F.struct(F.coalesce(title, F.lit(untitled)).alias("title"), F.array_join(cur, "\n").alias("content")))

    def flush(s: Column) -> Column:
        return F.when(F.length(F.array_join(s["cur"], "\n")) > least, F.concat(s["out"], piece(s["title"], s["cur"]))).otherwise(s["out"])

    def step(s: Column, line: Column) -> Column:
        head = F.coalesce(header(line), F.lit(False))
        grown = F.when(line != "", F.concat(s["cur"], F.array(line))).otherwise(s["cur"])
        n = s["n"] + F.length(line)
        over = n > most if most else F.lit(False)
        return (
            F.when(head, F.struct(flush(s).alias("out"), F.array(line).alias("cur"), line.alias("title"), F.length(line).alias("n")))
            .when(over, F.struct(F.concat(s["out"], piece(s["title"], grown)).alias("out"), F.array().cast("array<string>").alias("cur"), s["title"].alias("title"), F.lit(0).alias("n")))
            .otherwise(F.struct(s["out"].alias("out"), grown.alias("cur"), s["title"].alias("title"), n.alias("n")))
        )

    return F.aggregate(lines_of(text), start, step, flush)


def headed_sections(text: Column, header: Callable[[Column], Column], least: int, untitled: str) -> Column:
    """``sections`` without an upper size, cut at the places of the headers: linear in the lines of a text."""

    def once(value: Column, use: Callable[[Column], Column]) -> Column:
        return F.element_at(F.transform(F.array(value), use), 1)  # bound, so that it isn't computed for each element

    def cut(lines: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: F.coalesce(header(F.element_at(lines, i)), F.lit(False)))
        return once(F.array_distinct(F.concat(F.array(F.lit(1)), heads)), lambda starts: F.transform(starts, lambda s, i: piece(lines, starts, s, i)))

    def piece(lines: Column, starts: Column, s: Column, i: Column) -> Column:
        end = F.coalesce(F.get(starts, i + 1), F.size(lines) + 1)
        first = F.element_at(lines, s)
        content = F.array_join(F.filter(F.slice(lines, s, end - s), lambda x: x != ""), "\n")
        return F.struct(F.when(header(first), first).otherwise(F.lit(untitled)).alias("title"), content.alias("content"))

    return F.filter(once(lines_of(text), cut), lambda p: F.length(p["content"]) > least)


def book(text: Column, size: int = 3000) -> Column:
    def header(line: Column) -> Column:
        title = (F.length(line) < 50) & (line != "") & ~line.rlike("[。！？.!?，,]$")
        return line.rlike(CHAPTER) | title

    return sections(text, header, 100, NO_TITLE, size)


def _named(words: list[str], within: int) -> Callable[[Column], Column]:
    pattern = "|".join(words)
    return lambda line: F.lower(line).rlike(pattern) & (F.length(line) < within)


def paper(text: Column) -> Column:
    return headed_sections(text, _named(PAPER, 100), 50, NO_SECTION)


def resume(text: Column) -> Column:
    return headed_sections(text, _named(RESUME, 50), 20, NO_SECTION)


def _fit(values: Column, size: Column) -> Column:
    """``values`` padded with empty texts, or cut, to ``size``."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(""), size)), F.lit(1), size)


def _key_values(headers: Column, values: Column) -> Column:
    return F.array_join(F.zip_with(headers, _fit(values, F.size(headers)), lambda h, v: F.concat(h, F.lit(": "), v)), "\n")


def csv_rows(text: Column) -> Column:
    """A chunk of ``header: value`` lines for each row below the first line; no quoting."""
    raw = F.split(text, "\n", -1)
    headers = F.transform(F.split(strip(raw[0]), ",", -1), strip)
    numbered = F.transform(raw, lambda x, i: F.struct(i.alias("i"), strip(x).alias("line")))
    rows = F.filter(numbered, lambda r: (r["i"] > 0) & (r["line"] != ""))
    return F.transform(rows, lambda r: F.struct(r["i"].cast("string").alias("title"), _key_values(headers, F.transform(F.split(r["line"], ",", -1), strip)).alias("content")))


def markdown_rows(text: Column) -> Column:
    """A chunk for each row of a pipe table: its title if there is one, then ``header: value`` lines."""
    row = "array<struct<title:string,header:string,line:string,n:int>>"
    start = F.struct(F.array().cast(row).alias("out"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("header"), F.lit(0).alias("n"), F.lit(False).alias("inside"))

    def state(out: Column, title: Column, header: Column, n: Column, inside: Column) -> Column:
        return F.struct(out.alias("out"), title.alias("title"), header.alias("header"), n.alias("n"), inside.alias("inside"))

    none, zero, no, yes = F.lit(None).cast("string"), F.lit(0), F.lit(False), F.lit(True)

    def step(s: Column, line: Column) -> Column:
        same = state(s["out"], s["title"], s["header"], s["n"], s["inside"])
        ended = state(s["out"], s["title"], none, zero, no)
        full = s["header"].isNotNull() & (s["n"] > 0)
        titled = F.when(full, state(s["out"], strip(F.regexp_replace(line, "^#+", "")), none, zero, no)).otherwise(state(s["out"], strip(F.regexp_replace(line, "^#+", "")), s["header"], s["n"], no))
        new = F.struct(s["title"].alias("title"), s["header"].alias("header"), line.alias("line"), (s["n"] + 1).alias("n"))
        piped = F.when(line.rlike(r"^[|\-: \t]+$"), same).when(~s["inside"], state(s["out"], s["title"], line, zero, yes)).otherwise(state(F.concat(s["out"], F.array(new)), s["title"], s["header"], s["n"] + 1, yes))
        return F.when(line.startswith("#"), titled).when(line.contains("|"), piped).when(s["inside"] & full, ended).otherwise(same)

    rows = F.aggregate(lines_of(text), start, step, lambda s: s["out"])

    def shown(r: Column) -> Column:
        headers = F.filter(F.transform(F.split(r["header"], r"\|", -1), strip), lambda h: h != "")
        parts = F.split(r["line"], r"\|", -1)
        values = F.when(F.size(parts) > 2, F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), strip)).otherwise(F.array().cast("array<string>"))
        title = F.when(F.coalesce(r["title"], F.lit("")) != "", F.concat(F.lit("表格: "), r["title"], F.lit("\n\n"))).otherwise(F.lit(""))
        return F.struct(r["n"].cast("string").alias("title"), F.concat(title, _key_values(headers, values)).alias("content"))

    return F.transform(rows, shown)


def table_kind(text: Column) -> Column:
    """How the table method reads a text: ``csv``, ``markdown`` or ``general``, by its first ten lines."""
    first = F.slice(F.split(text, "\n", -1), 1, 10)
    return F.when(F.exists(first, lambda x: x.contains(",") & ~x.startswith("#")), "csv").when(F.exists(first, lambda x: x.contains("|")), "markdown").otherwise("general")


def table(text: Column) -> Column:
    kind = table_kind(text)
    return F.when(kind == "csv", csv_rows(text)).when(kind == "markdown", markdown_rows(text)).otherwise(general(text))


QA = r"(?isuU)(?:问题?[:：]|Q[:：])\s*(.+?)\s*(?:答案?[:：]|A[:：])\s*(.+?)(?=(?:问题?[:：]|Q[:：])|\z)"


def qa(text: Column) -> Column:
    asked, answered = F.regexp_extract_all(text, F.lit(QA), F.lit(1)), F.regexp_extract_all(text, F.lit(QA), F.lit(2))
    return F.zip_with(asked, answered, lambda q, a: F.struct(strip(q).alias("title"), F.concat(F.lit("问题: "), strip(q), F.lit("\n答案: "), strip(a)).alias("content")))


METHODS: dict[str, Callable[[Column], Column]] = {"naive": naive, "general": general, "book": book, "paper": paper, "resume": resume, "table": table, "qa": qa}
_FALLS_BACK = frozenset({"book", "paper", "resume", "qa"})


def register_chunker(name: str, method: Callable[[Column], Column]) -> None:
    """Make ``method`` (text column to array of (title, content)) available by name."""
    METHODS[name] = method


def pieces(text: Column, method: str) -> Column:
    """The chunks of a text by a method's name; an unknown name means ``general``."""
    found = METHODS.get(method, general)(text)
    return F.when(F.size(found) > 0, found).otherwise(general(text)) if method in _FALLS_BACK else found


def chunk_documents(docs: DataFrame, method: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, chunk_index (from 0), title, content, token_count, content_hash."""
    rows = docs.where(F.length(text_col) > 0).select(id_col, F.posexplode(pieces(F.col(text_col), method)).alias("i", "p"))
    return rows.select(id_col, F.col("i").cast("bigint").alias("chunk_index"), F.col("p.title").alias("title"), F.col("p.content").alias("content"), token_count(F.col("p.content")).alias("token_count"), F.sha2("p.content", 256).alias("content_hash"))


def keywords(docs: DataFrame, k: int = 5, first: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ``k`` most frequent runs of Chinese characters (two or more) of each text, or of its ``first`` characters; ties by first occurrence."""
    text = F.col(text_col) if first is None else F.substring(text_col, 1, first)
    words = docs.select(id_col, F.posexplode(F.regexp_extract_all(text, F.lit("([一-龥]{2,})"), F.lit(1))).alias("pos", "word"))
    counted = words.groupBy(id_col, "word").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"))
    by = W.partitionBy(id_col).orderBy(F.desc("n"), "pos")
    return counted.withColumn("rank", F.row_number().over(by).cast("bigint")).where(F.col("rank") <= k).select(id_col, "rank", "word", "n")


def questions(text: Column, count: int = 3, first: int | None = None) -> Column:
    """``count`` questions about a text, from its first sentences of more than ten characters."""
    text = text if first is None else F.substring(text, 1, first)
    said = F.slice(F.filter(F.transform(F.split(text, "[。！？.!?]", -1), strip), lambda s: F.length(s) > 10), 1, count)
    asked = F.transform(said, lambda s: F.when(s.contains("是") | s.contains("为"), F.concat(F.lit("关于这段内容，"), F.substring(s, 1, 20), F.lit("...的具体情况是什么？"))).when(s.contains("如何") | s.contains("怎么"), F.concat(F.substring(s, 1, 30), F.lit("...？"))).otherwise(F.concat(F.lit("这段内容中提到的"), F.substring(s, 1, 15), F.lit("...是什么意思？"))))
    return F.slice(F.concat(asked, F.array_repeat(F.lit(DEFAULT_QUESTION), count)), 1, count)
