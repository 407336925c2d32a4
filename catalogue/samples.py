"""Tables derived from the given ones by Spark: replies, pages, attempts, bodies.

``documents`` holds texts but no model replies, so a reply is derived for every
document. Its answers quote the whole text, an eighth each, two of its scores are those of
``labels``, its fields come from the other columns; the remaining scores follow a formula of the
document id. Its shape is one of twelve classes, from well formed to broken, so that each
document's expected record can be written in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue.sample_schema import ALLOWED_SCORES
from papersieve import fixed_values as fv

# Multiplier of the score formula for each question.
MULTIPLIERS = [3, 5, 7, 11, 13, 17, 19, 23]
PAGE_CHARS = 1000

BROADCAST_LABELS = 2_000_000
"""Labels that go to the texts as a whole, some 150 MB; beside more of them texts are shuffled."""


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, text`` as given."""
    return spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")


def document_ids(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id`` alone: where no text is needed, none is read."""
    return documents(spark, folder).select("doc_id")


def named(rows: DataFrame) -> DataFrame:
    return rows.withColumn("file_name", F.expr("'doc_' || doc_id || '.pdf'"))


def known_papers(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, file_name, has_text`` of the papers, from the character counts."""
    counts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "n_chars")
    has_text = F.expr("n_chars > 0 AND doc_id % 50 != 49")
    return named(counts).select("doc_id", "file_name", has_text.alias("has_text"))


def papers(texts: DataFrame) -> DataFrame:
    """``doc_id, file_name, text``; every fiftieth document could not be read."""
    return named(texts).withColumn("text", F.expr("if(doc_id % 50 = 49, NULL, text)"))


def _score(k: int) -> str:
    """Score of question ``k``, counted from 0, as the reply shows it."""
    allowed = ALLOWED_SCORES[k]
    h = f"((doc_id * {MULTIPLIERS[k]} + doc_id div {k + 2}) % 11)"
    choice = f"array({', '.join(f'{s}D' for s in allowed)})[int({h} % {len(allowed)})]"
    return f"string(if({h} < 7, {allowed[-1]}D, {choice}))"


def described(spark: SparkSession, folder: str) -> DataFrame:
    """What replies are made from: the texts and columns of ``documents``, and ``labels`` where there are any."""
    documents = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source", "lang", "n_chars")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    single = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    if labels.count() <= BROADCAST_LABELS:  # else Spark moves all texts for a few bytes each
        single = F.broadcast(single)
    return documents.join(single, "doc_id", "left")


def _item(qid: str, answer: str, shown: str) -> str:
    return f"'{qid}: ' || {answer} || gap || '{qid}{fv.SCORE_SUFFIX}: ' || {shown}"


def _eighth(k: int) -> str:
    """Part ``k``, counted from 1, of eight that make up the quoted text."""
    start, end = f"({k - 1} * length(quoted) div 8)", f"({k} * length(quoted) div 8)"
    return f"substring(quoted, int({start} + 1), int({end} - {start}))"


def replies(documents: DataFrame) -> DataFrame:
    """``doc_id, file_name, response``, one for each document.

    ``documents`` holds ``doc_id`` and what there is of ``described``; columns that it lacks count as NULL.
    """
    for name, kind in (("text", "string"), ("source", "string"), ("lang", "string"), ("n_chars", "bigint"),
                       ("quality", "int"), ("toxic", "int")):
        if name not in documents.columns:
            documents = documents.withColumn(name, F.lit(None).cast(kind))
    shown = [_score(k) for k in range(len(ALLOWED_SCORES))]
    shown[0] = f"if(quality IN (0, 1), string(double(quality)), {shown[0]})"
    shown[5] = f"if(toxic IN (0, 1), string(double(1 - toxic)), {shown[5]})"
    shown[2] += " || if(doc_id % 12 = 7 OR doc_id % 24 = 11, '.', '')"
    lines = [_item(f"QE{k}", _eighth(k), cell) for k, cell in enumerate(shown, 1)]
    items = " || gap || ".join(lines) + f""" || CASE doc_id % 12
        WHEN 8 THEN gap || {_item("QE2", "'note ' || doc_id || ' again'", "'1.0'")}
        WHEN 9 THEN gap || {_item("QE9", "'note ' || doc_id || ' again'", "'1.0'")}
        ELSE '' END"""
    # values are lower case on purpose: capitals at their end would move to the next key
    fields = """concat_ws(gap, 'TITLE: study of ' || regexp_replace(lower(substring(quoted, 1, 40)), '[^a-z]+', ' '),
        'AUTHOR: a. ' || regexp_replace(lower(coalesce(source, 'writer')), '[^a-z]+', ' '),
        'YEAR: ' || (2000 + coalesce(n_chars, doc_id) % 25),
        'VISION SYSTEM: camera ' || regexp_replace(lower(coalesce(lang, 'none')), '[^a-z]+', ' '))"""
    glued = f"{fv.QA_START} QE1: a QE1_SCORE:+1 QE2: b QE2_SCORE:-1 {fv.QA_END}"
    response = f"""CASE
        WHEN doc_id % 12 = 3 THEN
          concat_ws(gap, '{fv.QA_START}', items, '{fv.QA_END}', '{fv.DE_START}', fields)
        WHEN doc_id % 12 = 5 OR doc_id % 24 = 11 THEN
          concat_ws(gap, items, 'Data Extraction:', fields)
        WHEN doc_id % 12 = 6 THEN concat_ws(gap, '{fv.QA_START}', items)
        WHEN doc_id % 24 = 10 THEN NULL
        WHEN doc_id % 12 = 10 THEN ''
        WHEN doc_id % 12 = 11 THEN
          concat_ws(gap, '{glued}', '{fv.DE_START}', fields, '{fv.DE_END}')
        ELSE concat_ws(
          gap, '{fv.QA_START}', items, '{fv.QA_END}', '{fv.DE_START}', fields, '{fv.DE_END}')
        END"""
    # an answer must not look like the id of a question or the marker of a section
    quoted = "replace(replace(coalesce(text, ''), 'QE', 'qe'), '==', '--')"
    return (
        named(documents).withColumns({"gap": F.expr("if(doc_id % 12 = 4, ' ', chr(10))"), "quoted": F.expr(quoted)})
        .withColumns({"items": F.expr(items), "fields": F.expr(fields)})
        .select("doc_id", "file_name", F.expr(response).alias("response"))
    )


def pages(texts: DataFrame) -> DataFrame:
    """``doc_id, page_no, page_text``: every text cut into pages, in no set order."""
    count = F.ceil(F.length("text") / PAGE_CHARS).cast("int")
    numbered = texts.select(
        "doc_id", "text", F.explode(F.sequence(F.lit(1), F.greatest(count, F.lit(1)))).alias("page_no")
    )
    start = (F.col("page_no") - 1) * PAGE_CHARS + 1
    return numbered.select(
        "doc_id", "page_no", F.substr("text", start, F.lit(PAGE_CHARS)).alias("page_text")
    )


def earlier_manifest(ids: DataFrame) -> DataFrame:
    """``doc_id, status`` of a former run that decided a third of the documents."""
    d = F.col("doc_id")
    status = (
        F.when(d % 3 == 0, fv.ANALYSED).when(d % 3 == 1, fv.NO_RESPONSE).otherwise(fv.PARSE_ERROR)
    )
    return ids.select("doc_id", status.alias("status"))


def _chat_body(content: Column) -> Column:
    choice = F.struct(F.struct(content.alias("content")).alias("message"))
    return F.to_json(F.struct(F.array(choice).alias("choices")))


def bodies(ids: DataFrame) -> DataFrame:
    """``doc_id, body``: reply bodies that are whole, or lack a part."""
    d = F.col("doc_id")
    body = (
        F.when(d % 4 == 0, _chat_body(F.concat(F.lit("reply "), d.cast("string"))))
        .when(d % 4 == 1, '{"choices":[]}')
        .when(d % 4 == 2, '{"choices":[{"message":{}}]}')
        .otherwise('{"choices":[{"message":{"content":null}}]}')
    )
    return ids.select("doc_id", body.alias("body"))


def attempts(spark: SparkSession, folder: str) -> DataFrame:
    """Attempt rows from ``events``: four in turn belong to one document."""
    events = spark.read.parquet(f"{folder}/events.parquet").select("event_id", "event_type", "props")
    kind = F.col("event_type")
    answered = kind.isin("click", "view")
    return events.select(
        F.expr("event_id div 4").alias("doc_id"),
        (F.col("event_id") % 4 + 1).cast("int").alias("attempt"),
        F.when(answered, 200).when(kind == "signup", 503).when(kind == "error", 429)
        .alias("status_code"),
        F.when(kind == "purchase", "timeout").alias("error_kind"),
        F.when(kind == "click", _chat_body(F.concat(F.lit("reply "), F.col("props"))))
        .when(kind == "view", F.col("props")).alias("body"),
    )


def quality_quotes(texts: DataFrame) -> DataFrame:
    """Replies that quote the whole document as the answer to the first question."""
    response = F.concat(
        F.lit(f"{fv.QA_START}\nQE1: "), F.col("text"),
        F.lit("\nQE1_SCORE: 1.0\nQE2: short\nQE2_SCORE: 0.5\n" + fv.QA_END),
    )
    return texts.select("doc_id", response.alias("response"))


def field_quotes(texts: DataFrame) -> DataFrame:
    """Replies that quote the whole document as the last extraction field."""
    response = F.concat(
        F.lit(f"{fv.DE_START}\nYEAR: 2001\nTITLE: "), F.col("text"), F.lit("\n" + fv.DE_END)
    )
    return texts.select("doc_id", response.alias("response"))


def page_listings(spark: SparkSession, folder: str) -> DataFrame:
    """Replies whose unmarked field list is the whole source of a web page."""
    html = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html")
    # one line for each tag, led by the address, which always holds a colon
    lines = F.replace(F.col("html"), F.lit("<"), F.lit("\n<"))
    response = F.concat(F.lit("Data Extraction\nsource: "), F.col("url"), F.lit("\n"), lines)
    return html.select("page_id", response.alias("response"))


def glued_replies(ids: DataFrame) -> DataFrame:
    """Marked replies whose scores only the positional reading finds."""
    d = F.col("doc_id")
    response = F.concat(
        F.lit(f"{fv.QA_START}\nQE1: first "), d.cast("string"), F.lit(" QE1_SCORE:+1 QE2: second "),
        F.when(d % 2 == 0, "QE2_SCORE:-0.5 ").otherwise("QE2_SCORE: none "),
        F.when(d % 3 == 0, "QE1: once more ").otherwise(""),
        F.lit("QE30: third QE30_SCORE:+"), (d % 7).cast("string"), F.lit("e-1\n" + fv.QA_END),
    )
    return ids.select("doc_id", response.alias("response"))


def loose_replies(ids: DataFrame) -> DataFrame:
    """Replies without markers, in the looser spellings; some miss a score."""
    d = F.col("doc_id")
    response = F.concat(
        F.lit("My review.\nQE1. It is \"sound\" QE1 Score: 1.0\nQE2: part "), d.cast("string"),
        F.when(d % 2 == 0, "\nQE2Score 2").otherwise(""),
        F.lit("\nQE3: clear\nQE3_SCORE."), (d % 3).cast("string"), F.lit("\n"),
    )
    return ids.select("doc_id", response.alias("response"))


def lone_titles(ids: DataFrame) -> DataFrame:
    """Marked extraction sections that hold no key but a title in lower case."""
    d = F.col("doc_id")
    line = (
        F.when(d % 3 == 0, F.concat(F.lit("Title: foo "), d.cast("string")))
        .when(d % 3 == 1, F.concat(F.lit("title: "), d.cast("string"), F.lit("D")))
        .otherwise(F.concat(F.lit("The subtitle : "), d.cast("string"), F.lit(" x 9 by hand")))
    )
    response = F.concat(F.lit(fv.DE_START + "\n"), line, F.lit("\n" + fv.DE_END))
    return ids.select("doc_id", response.alias("response"))


def title_fields(ids: DataFrame) -> DataFrame:
    """Unmarked field lists with the title under one spelling, several, or none."""
    d = F.col("doc_id")
    n = d.cast("string")
    lines = (
        F.when(d % 5 == 0, F.concat(F.lit("title: small "), n, F.lit("\nTitle: mixed "), n))
        .when(d % 5 == 1, F.concat(F.lit("TITLE:\nTitle: hidden "), n))
        .when(d % 5 == 2, F.concat(F.lit("TITLE: first\nTITLE: last "), n))
        .when(d % 5 == 3, F.concat(F.lit("**\"title\"**: quoted \""), n, F.lit("\"")))
        .otherwise(F.lit("AUTHOR: someone"))
    )
    response = F.concat(F.lit("Data Extraction:\n"), lines, F.lit("\n\n\nTITLE: too late"))
    return named(ids).withColumn("response", response)


def review_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Reviews, questions and fields as tables: a customer's orders are its questions."""
    customers = spark.read.parquet(f"{folder}/customer.parquet")
    orders = spark.read.parquet(f"{folder}/orders.parquet").select(
        "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice"
    )
    reviews = customers.select(
        F.col("c_custkey").alias("review_id"), F.col("c_acctbal").alias("cutoff")
    )
    questions = orders.select(
        F.col("o_custkey").alias("review_id"),
        F.col("o_orderkey").alias("ord"),
        F.format_string("QE%d", "o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("question"),
        F.array(F.lit(0.0), F.lit(0.5), F.col("o_totalprice")).alias("scores"),
    )
    fields = orders.select(
        F.col("o_custkey").alias("review_id"),
        F.col("o_orderkey").alias("ord"),
        F.format_string("ORDER %s", "o_orderstatus").alias("field_key"),
        F.col("o_orderpriority").alias("description"),
    )
    return reviews, questions, fields


def capital_values(spark: SparkSession, folder: str) -> DataFrame:
    """Replies whose values end in capitals: source, number of characters and language of each document."""
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source", "lang", "n_chars")

    def shown(name: str) -> Column:
        return F.upper(F.coalesce(F.col(name), F.lit("none")))

    reply = F.concat(
        F.lit(f"{fv.DE_START}\nSOURCE: taken from "), shown("source"),
        F.lit("\nYEAR: "), F.coalesce("n_chars", F.lit(0)).cast("string"),
        F.lit("\nLICENSE: "), shown("lang"), F.lit(f" SEEN: no\n{fv.DE_END}"),
    )
    return rows.select("doc_id", reply.alias("response"))


def urgent_orders(spark: SparkSession, folder: str) -> DataFrame:
    """``review_id, ord, id``: urgent orders are the questions that exclude."""
    orders = spark.read.parquet(f"{folder}/orders.parquet").where("o_orderpriority = '1-URGENT'")
    return orders.select(
        F.col("o_custkey").alias("review_id"), F.col("o_orderkey").alias("ord"),
        F.format_string("QE%d", "o_orderkey").alias("id"),
    )


def line_replies(spark: SparkSession, folder: str) -> DataFrame:
    """A reply for each customer and line number: an item for each such line of the customer's orders.

    The score of an item is what the quantity leaves when it is divided by three; a field for each status of orders
    says how many lines there are.
    """
    orders = spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus")
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey"
    )
    line = F.struct("o_orderkey", "l_quantity", "l_partkey", "l_suppkey", "o_orderstatus")
    held = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("o_custkey").alias("review_id"), F.col("l_linenumber").cast("bigint").alias("doc_id"))
        .agg(F.sort_array(F.collect_list(line)).alias("lines"))
    )

    def item(x: Column) -> Column:
        qid = F.concat(F.lit("QE"), x["o_orderkey"].cast("string"))
        shown = (x["l_quantity"] % 3).cast("int").cast("string")
        return F.concat(
            qid, F.lit(": part "), x["l_partkey"].cast("string"), F.lit(" from "), x["l_suppkey"].cast("string"),
            F.lit("\n"), qid, F.lit(f"{fv.SCORE_SUFFIX}: "), shown, F.lit("\n"),
        )

    def field(status: Column) -> Column:
        n = F.size(F.filter("lines", lambda x: x["o_orderstatus"] == status)).cast("string")
        return F.concat(F.lit("ORDER "), status, F.lit(": seen "), n, F.lit("\n"))

    kinds = F.sort_array(F.array_distinct("lines.o_orderstatus"))
    response = F.concat(
        F.lit(fv.QA_START + "\n"), F.array_join(F.transform("lines", item), ""), F.lit(fv.QA_END + "\n"),
        F.lit(fv.DE_START + "\n"), F.array_join(F.transform(kinds, field), ""), F.lit(fv.DE_END),
    )
    return held.select(
        "review_id", "doc_id", F.format_string("line_%d.pdf", "doc_id").alias("file_name"),
        F.lit(True).alias("has_text"), response.alias("response"),
    )
