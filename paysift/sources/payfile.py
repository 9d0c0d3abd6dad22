"""Pay files: the 15-column text layout, readers and landing-folder helpers.

``raw_pay_file`` derives a pay file (all text, the file's own French headers)
from the fixture ledger, so ingestion, profiling and mapping operators run on
data that grows with the driver tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from paysift.functions.names import norm_text

from . import fixtures as fx
from .sinks import stored, together
from .tables import read_table

# The 15 file headers (in file order) and their canonical names.
FILE_HEADERS = [
    "N de ligne", "catégorie d'emploi", "code emploi", "titre d'emploi", "date de paie", "matricule",
    "employé", "catégorie de paie", "code de paie", "description du code de paie", "poste budgétaire",
    "description du poste budgétaire", "montant", "part employeur", "montant combiné",
]
CANONICAL = [
    "numero_ligne", "categorie_emploi", "code_emploi", "titre_emploi", "date_paie", "matricule",
    "nom_employe", "categorie_paie", "code_paie", "description_code_paie", "poste_budgetaire",
    "description_poste_budgetaire", "montant_employe", "part_employeur", "montant_combine",
]
# Required vs optional fields of the raw-line check (10 required, 5 optional).
OPTIONAL_FIELDS = ["part_employeur", "montant_combine", "titre_emploi", "code_emploi", "categorie_emploi"]
REQUIRED_FIELDS = [c for c in CANONICAL if c not in OPTIONAL_FIELDS]


def fr_money(cents_col) -> F.Column:
    """Cents -> French text amount 'd,cc' with a leading '-' when negative."""
    c = F.col(cents_col) if isinstance(cents_col, str) else cents_col
    a = F.abs(c)
    txt = F.concat((a / 100).cast("long").cast("string"), F.lit(","), F.lpad((a % 100).cast("string"), 2, "0"))
    return F.concat(F.when(c < 0, F.lit("-")).otherwise(F.lit("")), txt)


def pay_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the pay file as keys and numbers: what is moved or stored of them.

    :func:`pay_texts` makes the 15 text columns, which are several times as long. A line's file is that of its ``pay_date``."""
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey")
    people = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    people = people.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    return fx.ledger_lines(spark, sf_dir, people)


def pay_texts(spark: SparkSession, sf_dir: str, lines: DataFrame, *keep: str) -> DataFrame:
    """:func:`pay_lines` as the raw 15-column text pay file with the file headers, ``source_file`` and ``keep``."""
    nation = F.broadcast(read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    cd = F.broadcast(fx.codes(spark).select("pay_code", "label"))
    txt, date_raw = fx.raw_text_columns(iso=F.col("_iso"))
    known = F.col("c_nationkey").isNotNull()  # of no one's line all of these are null
    emp = {n: F.when(known, c) for n, c in fx.employee_texts("employee_id", "c_mktsegment").items()}
    # a step of the texts ahead of each join: as one projection their generated code is too long to be compiled
    j = fx.ledger_columns(lines, "c_nationkey", "c_mktsegment", F.col("pay_date").cast("string").alias("_iso"), *keep).join(cd, "pay_code", "left")
    j = j.select("*", txt.alias("_txt"), date_raw.alias("_date"), fr_money("employer_cents").alias("_employer"),
                 fr_money(F.col("amount_cents") + F.col("employer_cents")).alias("_both"))
    j = j.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    cols = [
        F.col("source_row_no").cast("string"), emp["categorie_emploi"], F.lit(None).cast("string"),
        F.col("n_name"), F.col("_date"), emp["matricule_raw"], emp["nom_complet"], F.col("categorie_paie"),
        F.col("pay_code"), F.col("label"), F.col("budget_post"), F.lit(None).cast("string"), F.col("_txt"),
        F.col("_employer"), F.col("_both"),
    ]
    return j.select(*[c.alias(h) for c, h in zip(cols, FILE_HEADERS)], "source_file", *keep)


def raw_pay_file(spark: SparkSession, sf_dir: str, arranged=None, *keep: str) -> DataFrame:
    """The ledger as a raw 15-column text pay file with the file headers.

    ``arranged`` moves or stores the lines before they are texts, and may add the columns ``keep``."""
    lines = pay_lines(spark, sf_dir)
    return pay_texts(spark, sf_dir, arranged(lines) if arranged else lines, *keep)


# windows-1252 differs from ISO-8859-1 in the C1 control range only
_C1 = {chr(b): bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def file_formats(lines: DataFrame, seps=(";", ",", "\t")) -> DataFrame:
    """One row per file of ``lines`` (:func:`text_lines`): utf8 (all of its bytes are UTF-8), header line, separator.

    Decided from every line of each file. Inside a split the running id follows
    the line order, so the smallest (offset, id) is the first line. The separator
    is the candidate that the header line holds most often."""
    lines = lines.withColumn("_o", F.struct("_at", F.monotonically_increasing_id()))
    per = lines.groupBy("file_path").agg(F.min(F.is_valid_utf8("value")).alias("utf8"), F.min_by("value", "_o").alias("_h"))
    raw = F.col("_h").cast("binary")
    header = F.when(F.col("utf8"), F.col("_h")).otherwise(F.translate(F.decode(raw, "ISO-8859-1"), "".join(_C1), "".join(_C1.values())))
    header = F.regexp_replace(header, "^\ufeff", "")
    best = F.array_max(F.array(*[F.struct((F.length("header") - F.length(F.replace("header", F.lit(x)))).alias("n"),
                                          F.lit(-i).alias("first"), F.lit(x).alias("sep")) for i, x in enumerate(seps)]))
    return per.select("file_path", "utf8", header.alias("header")).withColumn("sep", best["sep"])


def text_lines(reader) -> DataFrame:
    """(value, file_path, _at): lines of a text scan or text stream with file and split offset."""
    return reader.select("value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("_at"))


def _fields(line, sep) -> F.Column:
    """Fields of a delimited line: quoted ones without their quotes (a doubled quote is one), empty ones null.

    A line without a quote is only split; its empty fields are left to :func:`_field`."""
    def cut(x):
        raw = F.regexp_extract_all(F.concat(F.lit(x), line), F.lit(f'{x}("(?:[^"]|"")*"|[^{x}]*)'), 1)
        inner = lambda v: F.replace(F.substring(v, F.lit(2), F.length(v) - 2), F.lit('""'), F.lit('"'))
        quoted = F.transform(raw, lambda v: F.when(v.startswith('"') & v.endswith('"') & (F.length(v) >= 2), inner(v)).when(v != "", v))
        return F.when(line.contains('"'), quoted).otherwise(F.split(line, x, -1))
    return F.when(sep == ";", cut(";")).when(sep == ",", cut(",")).otherwise(cut("\t"))


def _field(at) -> F.Column:
    """The field of a data line at a place (from 0; null gives null): null if it is empty and not quoted."""
    v = F.get(F.col("_v"), at)
    return F.when(F.col("_quoted") | (v != ""), v)


def _decoded(value, utf8) -> F.Column:
    return F.when(utf8, value).otherwise(F.translate(F.decode(value.cast("binary"), "ISO-8859-1"), "".join(_C1), "".join(_C1.values())))


def _names(formats: DataFrame) -> DataFrame:
    """``formats`` with the header names of each file; a repeated name gets a number."""
    names = F.transform(_fields(F.col("header"), F.col("sep")), lambda x: F.coalesce(x, F.lit("")))
    f = formats.withColumn("_raw", names)
    before = lambda i, x: F.size(F.filter(F.slice("_raw", F.lit(1), i), lambda y: y == x))
    return f.withColumn("names", F.transform("_raw", lambda x, i: F.when(before(i, x) > 0, F.concat(x, F.lit("_"), before(i, x) + 1)).otherwise(x))).drop("_raw")


def _data_lines(lines: DataFrame, formats: DataFrame, *keep: str) -> DataFrame:
    """Fields (``_v``) of every line but the headers and empty lines, with ``keep`` columns of the file's format.

    A line that repeats its file's header is a header. One join by file: a large file is
    split like any other data, and no file is known to the driver."""
    f = formats.select("file_path", "utf8", "sep", F.col("header").alias("_header"), *keep)
    j = lines.select("value", "file_path").filter("value <> ''").join(f, "file_path")
    j = j.withColumn("_line", F.regexp_replace(_decoded(F.col("value"), F.col("utf8")), "^\ufeff", "")).filter(F.col("_line") != F.col("_header"))
    return j.select("file_path", *keep, _fields(F.col("_line"), F.col("sep")).alias("_v"), F.col("_line").contains('"').alias("_quoted"))


def read_files(lines: DataFrame, formats: DataFrame) -> DataFrame:
    """All files of ``formats`` as text columns in one plan, each with its own encoding, separator and header.

    The distinct header names become the columns, so the distinct layouts (not the files) are
    read first, from the formats, which are stored: their one reading of the lines serves both.
    The places of the columns are found once a file. Folders named ``key=value`` above a file are columns too, as in any Spark source."""
    named = _names(stored(formats, "formats"))
    keys = F.array_distinct(F.regexp_extract_all("file_path", F.lit("/([^/=]+)=[^/]*(?=/)"), 1))
    layouts = named.select("names", keys.alias("keys")).distinct().collect()
    columns = list(dict.fromkeys(n for r in sorted(layouts, key=lambda r: r["names"]) for n in r["names"]))
    folders = [k for k in dict.fromkeys(k for r in layouts for k in r["keys"]) if k not in columns]
    place = F.array(*[F.nullif(F.array_position("names", F.lit(c)).cast("int"), F.lit(0)) - 1 for c in columns])
    rows = _data_lines(lines, named.withColumn("_place", place), "_place")
    value = {c: _field(F.col("_place")[i]) for i, c in enumerate(columns)}
    folder = {k: F.url_decode(F.nullif(F.regexp_extract("file_path", f"/{re.escape(k)}=([^/]*)/", 1), F.lit(""))) for k in folders}
    return rows.select(*[v.alias(c) for c, v in value.items()],
                       *[v.alias(k) for k, v in folder.items()], "file_path")


def read_canonical(lines: DataFrame, formats: DataFrame) -> DataFrame:
    """All files of ``formats`` as the 15 canonical text columns and ``file_path``; nothing runs at plan time.

    Header names are mapped in the plan (the rules of ``mapping.header_map``): the first header
    that is a synonym of a column, else, in a file of 15 columns, the header at the column's place
    if it is no other column's. A column without a header is null."""
    from .mapping import HEADER_SYNONYMS
    known = F.create_map(*[F.lit(x) for canon, names in HEADER_SYNONYMS.items() for n in names for x in (n, canon)])
    plain = lambda h: norm_text(F.translate(h, "\xa0\u202f", "  "))
    mapped = _names(formats).withColumn("_c", F.transform("names", lambda h: known[plain(h)]))
    taken = lambda at: F.array_position("_c", F.get("_c", at)) == at + 1
    place = [F.when(F.array_contains("_c", c), F.array_position("_c", F.lit(c)).cast("int"))
             .when((F.size("names") == len(CANONICAL)) & ~F.coalesce(taken(F.lit(i)), F.lit(False)), F.lit(i + 1)) for i, c in enumerate(CANONICAL)]
    rows = _data_lines(lines, mapped.withColumn("_place", F.array(*place)), "_place")
    return rows.select(*[_field(F.col("_place")[i] - 1).alias(c) for i, c in enumerate(CANONICAL)], "file_path")


def read_pay_csv(spark: SparkSession, path: str, seps=(";", ",", "\t"), canonical: bool = False) -> DataFrame:
    """A1: read delimited pay files as text columns, each file in its own format.

    UTF-8 (with or without byte-order mark) where all bytes of the file are valid
    UTF-8, else windows-1252; the separator and the headers of each file's first
    line. Columns are never inferred; ``file_path`` tells the file."""
    lines = text_lines(spark.read.option("recursiveFileLookup", True).text(path))
    formats = file_formats(lines, seps)
    return read_canonical(lines, formats) if canonical else read_files(lines, formats)


def write_pay_files(df: DataFrame, path: str, sep: str = ";", deliveries: int = 1) -> None:
    """Write a pay file DataFrame as one CSV folder per source file (landing-folder layout).

    Lines are brought together by file first: otherwise every task writes a piece of every file, and
    the number of pieces, not that of lines, is what a reader or a stream pays for. With ``deliveries``
    each file comes in that many pieces, its lines dealt by their number."""
    folders = ["source_file"]
    if deliveries > 1:
        df = df.withColumn("delivery", _delivery(F.col(f"`{FILE_HEADERS[0]}`"), deliveries))
        folders = ["delivery", "source_file"]
    _write_texts(together(df, *folders), path, folders, sep)


def land_pay_file(spark: SparkSession, sf_dir: str, path: str, deliveries: int = 1, compression: str = "none") -> DataFrame:
    """The landing folder of the pay file (:func:`write_pay_files`), whose lines are brought together before they are texts.

    Returns the distinct pay dates of the ledger's lines, met on the way: no second derivation for the calendar."""
    keep, met = ["delivery"] if deliveries > 1 else [], Observation()

    def by_file(lines):
        if keep:
            lines = lines.withColumn("delivery", _delivery(F.col("source_row_no").cast("string"), deliveries))
        return together(lines, *keep, "pay_date").observe(met, F.collect_set("pay_date").alias("dates"))
    _write_texts(raw_pay_file(spark, sf_dir, by_file, *keep), path, [*keep, "source_file"], ";", compression)
    return spark.createDataFrame([(d,) for d in met.get["dates"]], "pay_date date")


def _delivery(row_no, deliveries: int) -> F.Column:
    return F.pmod(F.xxhash64(row_no), F.lit(deliveries)).cast("int")


def _write_texts(df: DataFrame, path: str, folders: list[str], sep: str, compression: str = "none") -> None:
    (df.write.mode("overwrite").option("header", True).option("sep", sep).option("encoding", "UTF-8").option("compression", compression)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .partitionBy(*folders).csv(path))
