"""Readers. All declare their schema: nothing is read twice to infer it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import process_str

WORD_BOXES = "image_id string, pass string, seq int, text string, `left` int, top int, width int, height int, conf double"
BOX_COLUMNS = [c.split()[0].strip("`") for c in WORD_BOXES.split(", ")]
_BOX = "struct<vertices:array<struct<x:int,y:int>>>"
ANNOTATIONS = (
    f"file string, full_text_annotation struct<pages:array<struct<blocks:array<struct<bounding_box:{_BOX},paragraphs:array<struct<words:array<struct<symbols:array<struct<text:string>>>>>>>>>>>,"
    f" text_annotations array<struct<description:string,bounding_poly:{_BOX}>>"
)
TSV = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, `left` int, top int, width int, height int, conf double, text string"


def images(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(image_id, width, height, channels, data) of every image under a path; all files make one table."""
    found = spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return found.select(F.col("image.origin").alias("image_id"), "image.width", "image.height", F.col("image.nChannels").alias("channels"), "image.data")


def word_boxes_tsv(spark: SparkSession, path: str, run: str = "full") -> DataFrame:
    """Word boxes from a recogniser's TSV files, a file an image; rows of structure without a word are left out."""
    rows = spark.read.csv(path, sep="\t", header=True, schema=TSV, quote="").where("level = 5")
    seq = F.row_number().over(_window("image_id", "page_num", "block_num", "par_num", "line_num", "word_num")) - 1
    return rows.withColumn("image_id", F.input_file_name()).select("image_id", F.lit(run).alias("pass"), seq.alias("seq"), "text", "left", "top", "width", "height", "conf")


def _window(by: str, *order: str):
    from pyspark.sql import Window

    return Window.partitionBy(by).orderBy(*order)


def annotations_json(spark: SparkSession, path: str) -> DataFrame:
    """Nested responses of a text detector, one JSON object a line."""
    return spark.read.json(path, schema=ANNOTATIONS)


def dictionary(table: DataFrame, column: str = "ingredients", least: int = 5, stop_words: DataFrame | None = None) -> DataFrame:
    """(word) of every distinct normalised word of at least so many letters, without stop words."""
    words = table.select(F.explode(F.split(process_str(column), " +")).alias("word")).where(F.length("word") >= least).distinct()
    return words if stop_words is None else words.join(stop_words.select("word"), "word", "left_anti")


def new_files(files: DataFrame, done: DataFrame, key: str = "file") -> DataFrame:
    """Files that no earlier result has."""
    return files.join(done.select(key).distinct(), key, "left_anti")


Recogniser = Callable[[bytes, int, int, int], pd.DataFrame]


def recognise(table: DataFrame, make: Callable[[], Recogniser], run: str = "full") -> DataFrame:
    """Word boxes of images by a recogniser that ``make`` builds once in each task; it takes data, width, height and channels and returns
    text, left, top, width, height and conf. A failure becomes a row with the error as text, conf -1 and seq -1."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = make()
        for batch in batches:
            for r in batch.itertuples():
                try:
                    words = call(r.data, r.width, r.height, r.channels).reset_index(drop=True)
                except Exception as e:  # one bad image doesn't end the job; the error is in the result
                    words = pd.DataFrame({"text": [str(e)], "left": [0], "top": [0], "width": [0], "height": [0], "conf": [-1.0]}, index=[-1])
                words.insert(0, "seq", words.index)
                words.insert(0, "pass", run)
                words.insert(0, "image_id", r.image_id)
                yield words[BOX_COLUMNS]

    return table.mapInPandas(of, WORD_BOXES)


def subcrops(crops: DataFrame, offset: int = 100) -> DataFrame:
    """Boxes of numbered crops (crop) of an image as one table: each crop's tops are moved down by its number times the offset."""
    moved = crops.withColumn("top", F.col("top") + F.col("crop") * offset)
    return moved.withColumn("seq", F.row_number().over(_window("image_id", "crop", "seq")) - 1).drop("crop")


def words_of(text: Column) -> Column:
    """Array of (line_no, word_no, text) of a text's words: blanks part words, newlines lines."""
    rows = F.transform(F.split(text, "\n"), lambda line, i: F.transform(F.filter(F.split(line, " "), lambda w: w != ""), lambda w, j: F.struct(i.alias("line_no"), j.alias("word_no"), w.alias("text"))))
    return F.flatten(rows)


def boxes_from_text(table: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(image_id, seq, line_no, text, left, top, width, height): a fixed-pitch page set from each row's text.

    seq comes with the explode. Only ``left`` needs a window; whoever doesn't read it has no shuffle."""
    from pyspark.sql import Window

    words = table.select(F.col(key).alias("image_id"), F.posexplode(words_of(F.col(text))).alias("seq", "w")).select("image_id", "seq", "w.line_no", "w.word_no", "w.text")
    before = Window.partitionBy("image_id", "line_no").orderBy("word_no").rowsBetween(Window.unboundedPreceding, -1)
    left = 10 * F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))
    return words.select("image_id", "seq", "line_no", "text", left.cast("int").alias("left"), (20 * F.col("line_no")).alias("top"), (10 * F.length("text")).alias("width"), F.lit(14).alias("height"))


#: Words printed on the labels derived from order lines, by the part's number.
PRINTED = ["Total Fat", "Saturated", "Trans", "Cholesterol", "Sodium", "Carbohydrate", "Fiber", "Sugars", "Protein", "Calories", "Vitamin A", "Iron", "Sucres", "Sugars alcohols", "Calories from fat", "Teneur de la", "Per", "Fat*"]


def label_lines(lineitem: DataFrame) -> DataFrame:
    """(image_id, line_no, text): each order becomes a label, each of its lines a printed line with a name, an amount and a share."""
    from pyspark.sql import Window

    keys = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    q, s = F.col("l_quantity").cast("int").cast("string"), F.col("l_suppkey") % 7
    name = F.element_at(F.array(*map(F.lit, PRINTED)), (F.col("l_partkey") % len(PRINTED) + 1).cast("int"))
    amount = F.concat(q, F.when(s == 0, ",5g").when(s == 1, "Omg").when(s == 2, "mg").when(s == 3, "gt").when(s == 4, " g").when(s == 5, "").otherwise("G"))
    share = F.when(F.col("l_tax") >= 0.04, F.concat(F.lit(" "), (F.col("l_discount") * 100).cast("decimal(9,0)").cast("string"), F.lit(" %"))).otherwise("")
    # named before the window, so that what goes by image_id finds the lines together
    printed = lineitem.select(F.col("l_orderkey").alias("image_id"), F.concat(name, F.lit(" "), amount, share).alias("text"), *keys)
    return printed.select("image_id", (F.row_number().over(Window.partitionBy("image_id").orderBy(*keys)) - 1).alias("line_no"), "text")


def label_boxes(lines: DataFrame) -> DataFrame:
    """Word boxes of printed lines (image_id, line_no, text); lines are 40 apart and 20 high."""
    from pyspark.sql import Window

    by = Window.partitionBy("image_id").orderBy("line_no", "word_no")
    words = lines.select("image_id", "line_no", F.posexplode(F.filter(F.split("text", " "), lambda w: w != "")).alias("word_no", "text"))
    before = Window.partitionBy("image_id", "line_no").orderBy("word_no").rowsBetween(Window.unboundedPreceding, -1)
    left = (10 * F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))).cast("int")
    return words.select("image_id", (F.row_number().over(by) - 1).alias("seq"), "text", left.alias("left"), (40 * F.col("line_no")).alias("top"), (10 * F.length("text")).alias("width"), F.lit(20).alias("height"))


def paired_lines(lineitem: DataFrame, names: list[str]) -> DataFrame:
    """(image_id, line_no, text): labels on whose lines two of the names stand, each with a share."""
    own, n = label_lines(lineitem), len(names)
    listed = F.array(*map(F.lit, names))
    pick = lambda c: F.element_at(listed, (F.pmod(c, F.lit(n)) + 1).cast("int"))
    return own.select("image_id", "line_no", F.concat(pick(F.col("image_id") + F.col("line_no")), F.lit(" 2 % "), pick(F.col("image_id") + 3 * F.col("line_no")), F.lit(" 4 %")).alias("text"))
