"""Corpus readers: JSON lines, EPO text files, patent XML, topics, qrels, span caches and embedding folders."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

XPATHS = "array<struct<xpath:string,text:string>>"


# ---- JSON lines -------------------------------------------------------------------------------------


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(seq, line): the lines of text files, numbered from 0 through files in order of name, whatever the partitions.

    A line's number is that of its block of a file, from one count a block, and its place in the block, which
    one task reads in order.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"), F.col("value").alias("line"))
    blocks = sorted((r["f"], r["b"], r["first"], r["n"]) for r in rows.groupBy("f", "b").agg(F.min("m").alias("first"), F.count(F.lit(1)).alias("n")).collect())  # one row a block
    base, before = [], 0
    for f, b, first, n in blocks:
        base.append((f, b, before - first))
        before += n
    shift = spark.createDataFrame(base, "f string, b long, shift long")
    return rows.join(F.broadcast(shift), ["f", "b"]).select((F.col("m") + F.col("shift")).alias("seq"), "line")


def read_jsonl(spark: SparkSession, path: str, entities: bool = True) -> DataFrame:
    return parse_jsonl(read_lines(spark, path), entities)


def parse_jsonl(lines: DataFrame, entities: bool = True) -> DataFrame:
    """(doc_id, title, abstract, claim, invention) from (seq, line); blank and broken lines are skipped and
    the last line of an id wins. Field values that are not strings are read as their JSON text."""
    top = F.from_json(F.col("line"), "map<string,string>")
    rows = lines.withColumn("top", top).filter(F.col("top").isNotNull() & (F.size("top") > 0))
    body = F.coalesce(F.from_json(F.element_at("top", F.lit("Content")), "map<string,string>"), F.col("top"))
    rows = rows.withColumn("body", body)
    named = F.coalesce(F.nullif(F.element_at("top", F.lit("dnum")), F.lit("")), F.element_at("top", F.lit("Application_Number")), F.concat(F.lit("doc_"), F.col("seq").cast("string")))
    joined = lambda start, by: F.array_join(F.transform(F.array_sort(F.filter(F.map_entries("body"), lambda e: F.startswith(e["key"], F.lit(start)))), lambda e: e["value"]), by)
    clean = lambda c: T.drop_escapes(c, entities)
    one = lambda k: T.strip(F.coalesce(F.element_at("body", F.lit(k)), F.lit("")))
    rows = rows.select(named.alias("doc_id"), F.struct("seq", one("title").alias("title"), clean(one("pa01")).alias("abstract"), clean(joined("c-en-", "\n")).alias("claim"), clean(joined("p0", " ")).alias("invention")).alias("r"))
    return rows.groupBy("doc_id").agg(F.max("r").alias("r")).select("doc_id", "r.title", "r.abstract", "r.claim", "r.invention")


def to_jsonl(docs: DataFrame) -> DataFrame:
    """(line): the same layout back, one object a document."""
    body = F.struct(F.col("title"), F.col("abstract").alias("pa01"), F.col("claim").alias("c-en-0001"), F.col("invention").alias("p0001"))
    return docs.select(F.to_json(F.struct(F.col("doc_id").cast("string").alias("dnum"), body.alias("Content"))).alias("line"))


# ---- EPO text ---------------------------------------------------------------------------------------


def parse_epo(files: DataFrame) -> DataFrame:
    """(doc_id, title, abstract, claim, invention) from (doc_id, text): a line with ' ::: ' opens a field,
    other lines continue it, unknown fields close it; documents with a title alone are dropped."""
    marked = F.regexp_replace("text", r"(?m)^(.*?) ::: ", "\x01$1\x02")
    fields = F.transform(F.filter(F.split(marked, "\x01"), lambda p: F.contains(p, F.lit("\x02"))), lambda p: F.struct(F.upper(T.strip(F.substring_index(p, "\x02", 1))).alias("k"), T.strip(F.substring_index(p, "\x02", -1)).alias("v")))
    get = lambda k: F.coalesce(F.try_element_at(F.filter("fields", lambda f: (f["k"] == k) & (f["v"] != "")), F.lit(-1))["v"], F.lit(""))
    out = files.withColumn("fields", fields).select("doc_id", get("TITLE").alias("title"), get("ABSTR").alias("abstract"), get("CLAIM1").alias("claim"), get("DESCR").alias("invention"))
    return out.filter("abstract <> '' or claim <> '' or invention <> ''")


def read_epo(spark: SparkSession, folder: str, year_min: int | None = None, year_max: int | None = None, max_docs: int | None = None, seed: int = 42) -> DataFrame:
    """A folder of <year>/<id>.txt; only the years asked for are listed, and a cap is shared among years."""
    from ..operators import sampling

    top = spark._jvm.org.apache.hadoop.fs.Path(folder)
    listed = [s.getPath().getName() for s in top.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(top)]
    years = sorted(int(y) for y in listed if y.isdigit() and (year_min or 0) <= int(y) <= (year_max or 9999))
    if not years:
        return parse_epo(spark.createDataFrame([], "doc_id string, text string"))
    paths = [f"{folder}/{y}" for y in years]
    files = spark.read.text(paths, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt")
    name = F.col("_metadata.file_path")
    files = files.select(F.regexp_extract(name, r"([^/]+)\.txt$", 1).alias("doc_id"), F.regexp_extract(name, r"/(\d+)/[^/]+$", 1).alias("year"), F.col("value").alias("text"))
    if max_docs is not None:
        files = sampling.by_budget(files, "year", "doc_id", sampling.year_caps(sampling.counts(files, "year"), max_docs), seed)
    return parse_epo(files)


# ---- patent XML -------------------------------------------------------------------------------------


def _name(e) -> str:
    return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""


def _passages(root) -> list[dict]:
    """Paths count each container's own children from 1; blank passages have a number but no row."""
    def numbered(parent, tag):
        return enumerate((c for c in parent if _name(c) == tag), 1)

    found = [(f"/patent-document/abstract[{i}]/p[{j}]", p) for i, a in numbered(root, "abstract") for j, p in numbered(a, "p")]
    found += [(f"/patent-document/description/p[{j}]", p) for _, d in numbered(root, "description") for j, p in numbered(d, "p")]
    found += [(f"/patent-document/claims/claim[{j}]", c) for _, k in numbered(root, "claims") for j, c in numbered(k, "claim")]
    return [{"xpath": x, "text": t} for x, e in found if (t := "".join(e.itertext()).strip())]


def parse_xml(files: DataFrame, lang: str = "EN") -> DataFrame:
    """(doc_id, lang, title, passages) from (doc_id, xml); files that don't parse give no row."""
    schema = pa.schema([("doc_id", pa.string()), ("lang", pa.string()), ("title", pa.string()), ("passages", pa.list_(pa.struct([("xpath", pa.string()), ("text", pa.string())])))])

    def run(batches):
        for b in batches:
            out = []
            for doc, xml in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    root = ET.fromstring(xml)
                except (ET.ParseError, TypeError):
                    continue
                titles = ("".join(e.itertext()).strip() for e in root.iter() if _name(e) == "invention-title" and (e.get("lang") or "").upper() == lang.upper())
                out.append({"doc_id": doc, "lang": root.get("lang", "unknown").upper(), "title": next(filter(None, titles), ""), "passages": _passages(root)})
            yield pa.RecordBatch.from_pylist(out, schema)

    return files.select(F.col("doc_id").cast("string"), "xml").mapInArrow(run, f"doc_id string, lang string, title string, passages {XPATHS}")


def passages_of(parsed: DataFrame, lang: str | None = None) -> DataFrame:
    """(passage_id, doc_id, xpath, text, title), of documents in one language if asked."""
    parsed = parsed if lang is None else parsed.filter(F.col("lang") == lang.upper())
    rows = parsed.select("doc_id", "title", F.explode("passages").alias("p")).select("doc_id", "p.xpath", "p.text", "title")
    return rows.select(F.concat("doc_id", F.lit("::"), "xpath").alias("passage_id"), "doc_id", "xpath", "text", "title")


def header_language(raw: Column, tag: str = "patent-document", head: int = 512) -> Column:
    found = F.regexp_extract(F.substring(raw, 1, head), rf'<{tag}[^>]+\blang="([^"]+)"', 1)
    return F.when(found != "", F.upper(found))


def indexed_xpath(xpath: Column) -> Column:
    """A path whose steps all bear an index, 1 where none is given, but for the root and plain containers."""
    return F.regexp_replace(xpath, r"/(p|claim|abstract)(?=/|$)", "/$1[1]")


def resolve(wanted: DataFrame, passages: DataFrame) -> DataFrame:
    """The passages that (doc_id, xpath) pairs name; unresolved ones drop out."""
    return wanted.withColumn("xpath", indexed_xpath(F.col("xpath"))).join(passages, ["doc_id", "xpath"])


# ---- claims, topics, qrels --------------------------------------------------------------------------


def expand_claims(claims: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, numbers, text): each document's target claims with all claims they refer to, by number.

    `claims` (doc_id, number, text), `targets` (doc_id, number). A reference is always to a smaller number,
    so one pass over a document's claims in falling order collects all ancestors.
    """
    most = F.max("number").over(Window.partitionBy("doc_id"))
    refs = claims.withColumn("most", most).select("doc_id", F.struct("number", T.claim_references(F.col("text"), F.col("number"), F.col("most")).alias("refs"), "text").alias("c"))
    docs = refs.groupBy("doc_id").agg(F.array_sort(F.collect_list("c")).alias("cs")).join(targets.groupBy("doc_id").agg(F.collect_set("number").alias("want")), "doc_id")
    need = F.aggregate(F.reverse("cs"), F.col("want"), lambda s, c: F.when(F.array_contains(s, c["number"]), F.array_union(s, c["refs"])).otherwise(s))
    out = docs.withColumn("need", need)
    kept = F.filter("cs", lambda c: F.array_contains(F.col("need"), c["number"]) & (c["text"] != ""))
    return out.select("doc_id", F.transform(kept, lambda c: c["number"]).alias("numbers"), F.array_join(F.transform(kept, lambda c: c["text"]), "\n").alias("text"))


def parse_topics(meta: DataFrame) -> DataFrame:
    """(tid, tfile, tclaims, tfam) from (text): blocks parted by blank lines; tid and tfile are required."""
    blocks = meta.select(F.explode(F.split(T.strip(F.col("text")), "\n\n")).alias("b"))
    get = lambda tag: T.strip(F.regexp_extract("b", rf"(?m)^\s*<{tag}>(.*?)(?:</{tag}>)?\s*$", 1))
    out = blocks.select(get("tid").alias("tid"), get("tfile").alias("tfile"), F.filter(F.split(get("tclaims"), r"\s+"), lambda x: x != "").alias("tclaims"), get("tfam-docs").alias("tfam"))
    return out.filter("tid <> '' and tfile <> ''")


def topic_texts(topics: DataFrame, claims: DataFrame, passages: DataFrame) -> DataFrame:
    """(tid, text): a topic's claims with ancestors, then its other passages; topics without text drop out."""
    paths = topics.select("tid", F.regexp_replace("tfile", r"\.xml$", "").alias("doc_id"), F.posexplode("tclaims").alias("k", "xpath"))
    claim = F.regexp_extract("xpath", r"/claim\[(\d+)\]$", 1)
    named = paths.filter(claim != "").select("tid", F.concat("doc_id", F.lit("\x1f"), "tid").alias("key"), "doc_id", claim.cast("int").alias("number"))
    own = claims.join(named.select("doc_id", "key").distinct(), "doc_id").select(F.col("key").alias("doc_id"), "number", "text")
    first = expand_claims(own, named.select(F.col("key").alias("doc_id"), "number")).select(F.substring_index("doc_id", "\x1f", -1).alias("tid"), F.lit(-1).alias("k"), "text")
    rest = resolve(paths.filter(claim == ""), passages).select("tid", "k", "text")
    parts = first.unionByName(rest).filter("text <> ''").groupBy("tid").agg(F.array_sort(F.collect_list(F.struct("k", "text"))).alias("p"))
    return parts.select("tid", F.array_join(F.transform("p", lambda x: x["text"]), " ").alias("text"))


def parse_qrels(lines: DataFrame) -> DataFrame:
    """(query_id, doc_id, xpath, passage_id) from (line); lines of fewer than three fields are skipped."""
    f = F.split("line", ",")
    get = lambda k: T.strip(F.get(f, F.lit(k)))
    return lines.filter(F.size(f) >= 3).select(get(0).alias("query_id"), get(1).alias("doc_id"), get(2).alias("xpath"), F.concat(get(1), F.lit("::"), get(2)).alias("passage_id"))


def qrel_corpus(passages: DataFrame, qrels: DataFrame, languages: DataFrame | None = None, lang: str = "EN") -> tuple[DataFrame, DataFrame]:
    """(passages that qrels name, qrels whose passage is there), of documents in one language if asked."""
    if languages is not None:
        qrels = qrels.join(languages.filter(F.col("lang") == lang).select("doc_id"), "doc_id", "left_semi")
    corpus = passages.join(qrels.select("passage_id").distinct(), "passage_id", "left_semi")
    return corpus, qrels.join(corpus.select("passage_id"), "passage_id", "left_semi")


def document_paths(paths: DataFrame) -> DataFrame:
    """(doc_id, path): where a document lies; topic files come before family documents, then the collection."""
    place = F.when(F.contains("path", F.lit("/tfiles/")), 0).when(F.contains("path", F.lit("/tfam-docs/")), 1).otherwise(2)
    doc = F.regexp_extract("path", r"([^/]+)\.xml$", 1)
    return paths.filter(doc != "").groupBy(doc.alias("doc_id")).agg(F.min(F.struct(place.alias("place"), "path")).alias("m")).select("doc_id", "m.path")


# ---- span caches and embeddings ---------------------------------------------------------------------


def write_span_cache(spans: DataFrame, path: str) -> None:
    """Gzip JSON lines {d, s, p, sp} from (d, s, p, sp)."""
    spans.select("d", "s", "p", "sp").write.mode("overwrite").option("compression", "gzip").json(path)


def read_span_cache(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("d string, s string, p string, sp array<array<string>>").json(path)
    return rows.withColumn("seq", F.monotonically_increasing_id()).groupBy("d", "s", "p").agg(F.max_by("sp", "seq").alias("sp"))


def embedding_folder(path: Column) -> Column:
    """STRUCT<model, unit, section> of .../<model>_<unit>/<section>_<unit>.npy."""
    unit = F.regexp_extract(path, r"_(spacy_token|noun_chunk|encoder_token)/[^/]+$", 1)
    return F.struct(F.regexp_extract(path, r"([^/]+)_(?:spacy_token|noun_chunk|encoder_token)/[^/]+$", 1).alias("model"), unit.alias("unit"), F.regexp_extract(path, r"/(abstract|claim|invention)_[^/]*\.np[yz]$", 1).alias("section"))
