"""Landed harvests: paginated note JSON, gzipped JSON lines, XML records, attachments."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

# Conference, API generation.
VENUES = {"ICLR": 2, "NeurIPS": 2, "ICML": 2}
RECORD = "STRUCT<identifier: STRING, deleted: STRING, title: STRING, created: STRING, updated: STRING, categories: STRING, abstract: STRING, keynames: ARRAY<STRING>>"


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Records of (gzipped) JSON lines; blank lines are skipped."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def attachments(spark: SparkSession, path: str, max_bytes: int = 20 << 20) -> DataFrame:
    """Binary files up to max_bytes; the length is filtered before any content is read."""
    return spark.read.format("binaryFile").load(path).filter(F.col("length") <= max_bytes)


def land_files(rows: DataFrame, root: str, key: str, value: str, per_folder: int = 1000) -> None:
    """Write each row's text and a line feed as a file, named by its key; tasks write them, about per_folder of them to a folder.

    A task that runs again writes the same names. Any store that pyarrow writes will do.
    """
    n = max(1, -(-rows.count() // per_folder))

    def write(batches):
        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(root if "://" in root else "file://" + root)
        seen: dict = {}
        for pdf in batches:
            for folder, name, text in pdf.itertuples(index=False, name=None):
                if folder not in seen:
                    where.create_dir(f"{base}/f{folder}", recursive=True)
                    seen[folder] = {}
                again = seen[folder][name] = seen[folder].get(name, -1) + 1  # rows that repeat a key
                with where.open_output_stream(f"{base}/f{folder}/{key}={name}.{again}.txt") as out:
                    out.write(text.encode() + b"\n")
            yield pdf[["folder"]].iloc[:0]

    folder = F.pmod(F.xxhash64(key), F.lit(n)).alias("folder")
    where_to = rows.select(folder, F.coalesce(F.col(key).cast("string"), F.lit("")).alias("name"), F.col(value).alias("text")).repartition("folder")
    where_to.mapInPandas(write, "folder long").count()


def records(xml: Column) -> Column:
    """A harvested record's struct from its XML text."""
    return F.from_xml(xml, F.lit(RECORD))


def parsed_records(rows: DataFrame, xml_col: str = "xml") -> DataFrame:
    """Records with a title that aren't deleted; white space collapsed, categories split."""
    squeezed = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    r = rows.select(records(F.col(xml_col)).alias("r")).filter(F.col("r.deleted").isNull() & (F.coalesce(squeezed(F.col("r.title")), F.lit("")) != ""))
    return r.select(F.col("r.identifier").alias("id"), squeezed(F.col("r.title")).alias("title"), squeezed(F.col("r.abstract")).alias("abstract"), "r.created", "r.updated", F.split("r.categories", r"\s+").alias("categories"), "r.keynames")


def forum_replies(notes: DataFrame, papers: DataFrame) -> DataFrame:
    """All notes of the papers' forums (papers: forum), the submissions among them."""
    return notes.join(papers.select("forum").distinct(), "forum", "left_semi")


def note_edits(edits: DataFrame, papers: DataFrame) -> DataFrame:
    """(note_id, edits): each note's edits, oldest first; none for papers (note_id, conference) of an API without edit logs."""
    version = F.element_at(F.create_map(*[F.lit(x) for pair in VENUES.items() for x in pair]), F.col("conference"))
    known = papers.select("note_id", (F.coalesce(version, F.lit(1)) == 2).alias("logged"))
    rows = edits.join(known.filter("logged"), "note_id", "left_semi").withColumn("tcdate", F.coalesce("tcdate", F.lit(0).cast("long")))
    found = rows.groupBy("note_id").agg(F.array_sort(F.collect_list(F.struct("tcdate", "edit_id", "content"))).alias("edits"))
    kind = found.schema["edits"].dataType
    return known.select("note_id").distinct().join(found, "note_id", "left").select("note_id", F.coalesce("edits", F.array().cast(kind)).alias("edits"))


FEED = "STRUCT<entry: ARRAY<STRUCT<id: STRING, title: STRING>>>"


def first_entries(feeds: DataFrame) -> DataFrame:
    """(asked, id, title): the first entry of each landed answer (asked, xml) to a title search; none where there is no entry.

    The id is the part of the entry's address behind /abs/, old ones with their archive, without the version.
    """
    entry = F.get(F.from_xml("xml", F.lit(FEED))["entry"], F.lit(0))
    title = F.trim(F.regexp_replace(entry["title"], r"\s+", " "))
    ref = F.regexp_replace(F.element_at(F.split(entry["id"], "/abs/"), -1), r"v\d+$", "")
    return feeds.select("asked", ref.alias("id"), title.alias("title")).filter("id IS NOT NULL")


class TokenPages(DataSource):
    """Pages of a search or harvest that name the next one by a token: option fetch names module:function(part, token).

    The function returns (rows, token), rows being a list of texts; a page without rows or without a token is the last. Option
    parts names the sets that are harvested apart from one another (a JSON object of their first tokens, empty at the
    beginning), a task for each, since a page depends on the one before. Rows come out page by page, as (part, page,
    content, next_token); resume_points() of what was landed is the next run's parts.
    """

    @classmethod
    def name(cls) -> str:
        return "token_pages"

    def schema(self) -> str:
        return "part string, page int, content string, next_token string"

    def reader(self, schema) -> DataSourceReader:
        return _TokenReader(self.options)


class _TokenReader(DataSourceReader):
    def __init__(self, options):
        self.fetch, self.parts, self.pages = options["fetch"], json.loads(options.get("parts", '{"": ""}')), int(options.get("pages", "0"))

    def partitions(self):
        return [InputPartition(x) for x in sorted(self.parts.items())]

    def read(self, partition):
        import importlib

        part, token = partition.value
        module, _, name = self.fetch.partition(":")
        call, page = getattr(importlib.import_module(module), name), 0
        while not self.pages or page < self.pages:
            rows, token = retried(lambda token=token: call(part, token))
            yield from ((part, page, row, token or None) for row in rows)
            if not rows or not token:
                return
            page += 1


#: Pages that land_pages() puts into a folder and that a task of a stream reads.
PAGES = 500


def landed_block(root: str, part: str, block: int, columns: list[str]) -> dict[str, dict]:
    """The pages by token of a block that land_pages() wrote, with the columns asked for; none where there is no block. Any store
    that pyarrow reads will do."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    where, base = fs.FileSystem.from_uri(root if "://" in root else "file://" + root)
    folder = f"{base}/part={part}/block={block}"
    if where.get_file_info(folder).type != fs.FileType.Directory:
        return {}
    return {r["token"]: r for r in ds.dataset(folder, filesystem=where, format="parquet").to_table(columns=["token", *columns]).to_pylist()}


def land_pages(records: DataFrame, root: str, part: str, order: str, xml: str, size: int) -> None:
    """Write records as pages of size, as a service would give them: part by part, each page with the token of the next.

    part, order and xml name the columns of records; part's values must do as names of folders. The first token is 0. PAGES
    pages that follow each other stand in a folder.
    """
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(part).orderBy(order)) - 1
    paged = records.withColumn("n", n).withColumn("page", F.floor(F.col("n") / size))
    pages = paged.groupBy(F.col(part).alias("part"), "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.col(xml).alias("x")))), lambda r: r["x"]), "").alias("x"))
    last = paged.groupBy(F.col(part).alias("part")).agg(F.max("page").alias("last"))
    following = F.when(F.col("page") < F.col("last"), (F.col("page") + 1).cast("string"))
    block = F.floor(F.col("page") / PAGES).alias("block")
    rows = pages.join(last, "part").select("part", block, F.col("page").cast("string").alias("token"), F.concat(F.lit("<page>"), "x", F.lit("</page>")).alias("xml"), following.alias("next"))
    rows.repartition("part", "block").write.partitionBy("part", "block").parquet(root)


class HarvestStream(DataSource):
    """A stream of a harvest's pages, part by part: option root is a folder of landed pages, parts a JSON list of names.

    The offset is the token that each part goes on with and its page's number, so a stopped stream goes on where it was,
    each page once. A batch takes at most option pages of each part (0: all there are); the driver follows the tokens, block by
    block and without the pages, which are read in tasks, one for those of a block. Rows: part, page, xml.
    """

    @classmethod
    def name(cls) -> str:
        return "harvest_stream"

    def schema(self) -> str:
        return "part string, page int, xml string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _HarvestReader(self.options)


class _HarvestReader(DataSourceStreamReader):
    def __init__(self, options):
        self.root, self.parts, self.pages, self.at = options["root"], json.loads(options["parts"]), int(options.get("pages", "0")), None

    def initialOffset(self) -> dict:
        return {part: ["0", 0] for part in self.parts}

    def _follow(self, part: str, token: str, page: int, most: int):
        """The runs (page, token, number of pages) of a part from a token on, one a block, and where it goes on after them; an empty token is its end."""
        runs, left = [], most or float("inf")
        while token and left:
            block, first, known = page // PAGES, (page, token), retried(lambda block=page // PAGES: landed_block(self.root, part, block, ["next"]))
            while token in known and left and page // PAGES == block:
                token, page, left = known[token]["next"] or "", page + 1, left - 1
            if page == first[0]:
                break
            runs.append((*first, page - first[0]))
        return runs, [token, page]

    def latestOffset(self) -> dict:
        start = self.at or self.initialOffset()
        return {part: self._follow(part, *start.get(part, ["0", 0]), self.pages)[1] for part in self.parts}

    def partitions(self, start: dict, end: dict):
        out = []
        for part in self.parts:
            token, page = start.get(part, ["0", 0])
            if end[part][1] > page:
                out += [InputPartition((part, *run)) for run in self._follow(part, token, page, end[part][1] - page)[0]]
        self.at = end
        return out

    def read(self, partition):
        part, first, token, most = partition.value
        known = retried(lambda: landed_block(self.root, part, first // PAGES, ["xml", "next"]))
        for page in range(first, first + most):
            yield part, page, known[token]["xml"]
            token = known[token]["next"]

    def commit(self, end: dict) -> None:
        self.at = end


def resume_points(landed: DataFrame) -> DataFrame:
    """(part, next_token) of landed pages: where each part goes on; null where it is done."""
    return landed.groupBy("part").agg(F.max_by("next_token", "page").alias("next_token"))


class PagedNotes(DataSource):
    """Notes of an offset-paginated service, a partition for each page: option fetch names module:function(offset, limit).

    The function returns a list of (id, json) and a shorter list than limit on the last page. option total is the probe
    of the number of notes; option root, where given, is the function's third argument. option pages is how many pages
    that follow each other a partition has (1 if not given).
    """

    @classmethod
    def name(cls) -> str:
        return "paged_notes"

    def schema(self) -> str:
        return "id string, content string"

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(self.options)


class _PageReader(DataSourceReader):
    def __init__(self, options):
        self.fetch, self.total, self.limit, self.root = options["fetch"], int(options["total"]), int(options.get("limit", "1000")), options.get("root")
        self.step = self.limit * int(options.get("pages", "1"))

    def partitions(self):
        return [InputPartition(offset) for offset in range(0, max(1, self.total), self.step)]

    def read(self, partition):
        import importlib

        module, _, name = self.fetch.partition(":")
        more = (self.root,) if self.root else ()
        call = getattr(importlib.import_module(module), name)
        for offset in range(partition.value, max(1, min(partition.value + self.step, self.total)), self.limit):
            yield from retried(lambda offset=offset: call(offset, self.limit, *more))


def retried(call, attempts: int = 3, decide=lambda error: True):
    """call(), again while decide(error) allows it; Spark retries the task after that."""
    for left in range(attempts - 1, -1, -1):
        try:
            return call()
        except OSError as error:
            if not left or not decide(error):
                raise
