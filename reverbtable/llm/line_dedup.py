"""Line dedup by a log-template tree.

Every line goes down a tree of fixed depth: its number of words, then its first three words, where a word with a
digit counts as a variable field. In a leaf, a line joins the leaf's most frequent line when 7 of 10 positions agree,
those left over join the most frequent of them, and so on until no two are left that agree; a round takes many such
heads at once. The positions that differ are the template's variable fields. A
template that stands in enough documents is dropped wherever it stands, but for the document with the smallest id, so
that a group of copied documents keeps one whole copy.

Lines travel as hashes: leaf, masked line, and two bytes per word to compare positions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from reverbtable.llm.book import query, table
from reverbtable.session import written

DEPTH = 3
HEADS = 64        # lines of a leaf that may become heads in the first round, twice as many in each further one
MOST_HEADS = 4096     # and at most so many in one
PART_LINES = 8192     # distinct lines of a leaf that meet its heads together
HOT_LINES = 1 << 14   # lines above this part of all rows are decided by a broadcast of fewer than so many
AGREE = (7, 10)
MIN_WORDS = 3     # shorter lines are never dropped
LONG_WORDS = 20   # a template of so many words recurs with two documents, a shorter one
MIN_DOCS = 3      # with three

# fixed values
WHITE = " \t\n\x0b\x0c\r"
BLANK, WORD = f"[{WHITE}]", f"[^{WHITE}]"


def _number(text):
    """60 bits of a digest."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def parsed(docs: DataFrame) -> DataFrame:
    """Lines of docs(rid, doc_id, text) that have MIN_WORDS words: rid, doc_id, pos, n, leaf, line, marks."""
    lines = docs.select("rid", "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "s"))
    # anchored, possessive patterns: every character of a long word is read once
    enough = lines.where(F.col("s").rlike(f"^{BLANK}*+" + f"{WORD}++{BLANK}++" * (MIN_WORDS - 1) + WORD))
    masked = F.when(F.col("s").rlike("[0-9]"), F.regexp_replace(
        "s", f"(?<!{WORD})[^0-9{WHITE}]*+[0-9]{WORD}*+", "<*>")).otherwise(F.col("s"))
    cut = enough.withColumn("w", F.array_remove(F.split(masked, BLANK), ""))
    return cut.select("rid", "doc_id", "pos", F.size("w").alias("n"),
                      F.xxhash64(F.size("w"), *[F.get("w", k) for k in range(DEPTH)]).alias("leaf"),
                      _number(F.concat_ws(" ", "w")).alias("line"),
                      F.transform("w", lambda x: F.shiftright(F.xxhash64(x), 48).cast("smallint")).alias("marks"))


def distinct_lines(lines: DataFrame) -> DataFrame:
    """One row per line of parsed(): leaf, line, n, times, docs (documents that hold it), first and last (of their ids).

    Occurrences meet by (line, document) before they meet by line, so a line that stands everywhere is many groups.
    """
    once = lines.groupBy("leaf", "line", "n", "doc_id").agg(F.count("*").alias("times"))
    return once.groupBy("leaf", "line", "n").agg(F.sum("times").alias("times"), F.count("*").alias("docs"),
                                                 F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


def templates(lines: DataFrame, kinds: DataFrame | None = None, most: int = MOST_HEADS) -> DataFrame:
    """(line, template): lines that joined the template of another line of their leaf.

    kinds is distinct_lines(lines), if it is at hand. No row holds more than `most` heads; a leaf with more templates
    takes more rounds. The lines of a large leaf meet its heads in parts of about PART_LINES.
    """
    kinds = distinct_lines(lines) if kinds is None else kinds
    several = kinds.groupBy("leaf").agg(F.count("*").alias("lines")).where("lines > 1")
    shared = kinds.select("leaf", "line", "times").join(several, "leaf").withColumn(
        "parts", F.ceil(F.col("lines") / PART_LINES).cast("int")).drop("lines")
    # only leaves with several lines need positions; a line's marks are the same wherever it stands
    marks = lines.groupBy("line").agg(F.first("marks").alias("marks"))
    rest = written(marks.join(shared, "line").withColumn("part", F.pmod("line", "parts").cast("int")), "leaf-lines")

    def agree(marks, to):
        same = F.size(F.filter(F.zip_with(marks, to, lambda a, b: a == b), lambda x: x))
        return same * AGREE[1] >= F.size(marks) * AGREE[0]

    def first_head(marks, heads):
        return F.get(F.filter(heads, lambda h: agree(marks, h["marks"])), 0)

    found, width = None, min(HEADS, most)
    while True:
        # the leaf's first lines in order: those that agree with none before them are heads
        rank = F.row_number().over(Window.partitionBy("leaf").orderBy(F.desc("times"), F.desc("line")))
        top = rest.select("leaf", "parts", "line", "marks", rank.alias("rank")).where(F.col("rank") <= width)
        top = top.groupBy("leaf", "parts").agg(F.sort_array(F.collect_list(F.struct("rank", "line", "marks"))).alias("top"))
        heads = top.where(F.size("top") > 1).select("leaf", F.aggregate(
            "top", F.slice("top", 1, 0), lambda h, x: F.when(
                F.exists(h, lambda y: agree(x["marks"], y["marks"])), h).otherwise(F.concat(h, F.array(x)))).alias("heads"),
            F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        # a head agrees with no head but itself
        tried = written(rest.join(heads, ["leaf", "part"]).withColumn(
            "template", first_head(F.col("marks"), F.col("heads"))["line"]).drop("heads"), "tried")
        joined = tried.where("line <> template").select("line", "template")
        found = joined if found is None else found.unionByName(joined)
        rest = tried.where("template is null").drop("template")
        if rest.isEmpty():
            return found
        width = min(2 * width, most)


def recurring(kinds: DataFrame, joined: DataFrame) -> DataFrame:
    """(line, first, times): lines whose template stands in enough documents, and the smallest id among these.

    kinds is distinct_lines(), joined is templates(). Two ids tell all of a line that stands in at most two documents;
    one of more documents makes its template recur by itself.
    """
    heads = joined.select(F.col("template").alias("line"), "template").distinct()
    of = kinds.join(joined.unionByName(heads), "line", "left").where("template is not null or docs > 1").select(
        "line", F.coalesce("template", "line").alias("template"), "n", "times", "docs", "first", "last")
    of = written(of, "of-template")
    ids = of.select("template", "n", "docs", F.explode(F.array("first", "last")).alias("doc_id")).groupBy(
        "template", "n", "doc_id").agg(F.max("docs").alias("docs"))
    docs_of = ids.groupBy("template", "n").agg(F.greatest(F.count("*"), F.max("docs")).alias("docs"),
                                               F.min("doc_id").alias("first"))
    least = F.when(F.col("n") >= LONG_WORDS, 2).otherwise(MIN_DOCS)
    return of.select("line", "times", "template").join(
        docs_of.where(F.col("docs") >= least).select("template", "first"), "template").select("line", "first", "times")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with text cut by its recurring lines, plus n_lines and n_dropped; other columns and the row count stay.

    A line's words are runs of non-blank characters. Null and empty texts stay as they are (0 lines dropped; null has
    0 lines). Columns named n_lines or n_dropped are replaced. A line repeated inside one document counts once for it and is not dropped for that alone. Rows that
    repeat an id are one document; a null id stands for the hash of its text. A document may be left with empty text.
    Lines of equal counts are ordered by their hash. A very long text is cut into its lines by one task.
    """
    key = F.xxhash64(doc_id, text)  # with the id beside it: 64 bits tell the texts of one id apart
    ids = F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(text))
    lines = written(parsed(docs.select(key.alias("rid"), ids.alias("doc_id"), F.col(text).alias("text"))), "lines")
    kinds = written(distinct_lines(lines), "distinct-lines")
    dropped = written(recurring(kinds, templates(lines, kinds)), "recurring")
    # fewer than HOT_LINES lines hold more than that part of all rows: they are sent to every task, and no other line
    # is a large share of the rows that meet by line
    often = F.col("times") * HOT_LINES > F.lit(kinds.agg(F.sum("times")).first()[0] or 0)
    hot = kinds.where(often).select("line").join(dropped.select("line", "first"), "line", "left")
    met = lines.select("rid", "doc_id", "pos", "line").join(
        F.broadcast(hot.withColumn("hot", F.lit(True))), "line", "left")
    cold = met.where("hot is null").drop("hot", "first").join(dropped.where(~often).select("line", "first"), "line")
    gone = met.where("hot").drop("hot").unionByName(cold).where(F.col("doc_id") != F.col("first"))
    gone = gone.groupBy(F.col("rid").alias("_rid"), F.col("doc_id").alias("_id")).agg(F.collect_set("pos").alias("_gone"))
    out = docs.select(F.struct(*docs.columns).alias("_row"), key.alias("_rid"), ids.alias("_id")).join(
        gone, ["_rid", "_id"], "left")
    whole = F.col("_row").getField(text)
    split = F.split(whole, "\n")
    kept = F.array_join(F.filter(split, lambda x, i: ~F.array_contains("_gone", i)), "\n")
    made = {text: F.when(F.col("_gone").isNull(), whole).otherwise(kept),
            "n_lines": F.coalesce(F.size(split), F.lit(0)).cast("long"),
            "n_dropped": F.coalesce(F.size("_gone"), F.lit(0)).cast("long")}
    return out.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns if c not in made],
                      *[v.alias(c) for c, v in made.items()])


_NUMBER = "cast('0x' || substr(md5({}), 1, 15) as bigint)"
_ROUND = """
head{k} as (select leaf, max(struct_pack(a := times, b := line)).b as template, count(*) as lines from rest{k} group by leaf),
try{k} as (select r.*, h.template,
    10 * len(list_filter(list_zip(r.w, t.w), lambda x: x[1] = x[2])) >= 7 * r.n as joins
  from rest{k} r join head{k} h on r.leaf = h.leaf and h.lines > 1 join keyed t on t.line = h.template),
rest{n} as (select leaf, line, n, w, times from try{k} where not joins),"""


@query("op3_line_dedup", f"""
with cut as (
  select doc_id, text, unnest(string_split(text, chr(10))) as s, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos
  from documents),
words as (
  select doc_id, pos, list_transform(list_filter(string_split(translate(s, chr(9)||chr(10)||chr(11)||chr(12)||chr(13),
    '     '), ' '), lambda x: x <> ''), lambda x: case when regexp_matches(x, '[0-9]') then '<*>' else x end) as w from cut),
lines as (
  select doc_id, pos, w, len(w) as n, {_NUMBER.format("len(w) || ' ' || array_to_string(w[1:3], ' ')")} as leaf,
    {_NUMBER.format("array_to_string(w, ' ')")} as line from words where len(w) >= 3),
keyed as (select leaf, line, n, any_value(w) as w, count(*) as times from lines group by leaf, line, n),
rest1 as (select * from keyed where leaf in (select leaf from keyed group by leaf having count(*) > 1)),{
    "".join(_ROUND.format(k=k, n=k + 1) for k in (1, 2))}
map as (select line, template from try1 where joins and line <> template union all
        select line, template from try2 where joins and line <> template),
held as (select l.doc_id, l.pos, l.n, coalesce(m.template, l.line) as template from lines l left join map m using (line)),
rec as (select template, min(doc_id) as first from held group by template, n
        having count(distinct doc_id) >= case when n >= 20 then 2 else 3 end),
gone as (select doc_id, pos from held join rec using (template) where doc_id <> first),
kept as (select c.doc_id, string_agg(s, chr(10) order by c.pos) filter (where g.pos is null) as text, count(g.pos) as n_dropped
         from cut c left join gone g on c.doc_id = g.doc_id and c.pos = g.pos group by c.doc_id)
select d.doc_id, case when k.n_dropped > 0 then coalesce(k.text, '') else d.text end as text,
  coalesce(len(string_split(d.text, chr(10))), 0) as n_lines, coalesce(k.n_dropped, 0) as n_dropped
from documents d left join kept k on d.doc_id = k.doc_id""")
def op3(spark, sf_dir):
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
