"""Exact duplicates by progressive refinement (operator 13), with DataFrame functions only.

Texts are equal if they are the same after lower-casing A-Z. Three scans narrow the candidates: lengths that occur once need no
more; of the others, a hash of the beginning is taken, and only texts that share length and that hash are hashed whole. What
a scan has to look at is told by a bitmap of the groups that the scan before has left, so that no text is ever shuffled.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, rows_kept, table
from .graph import hot_bound

#: Characters that the hash of the beginning covers.
BEGINNING = 256
#: Bits of a bitmap for each group that it holds, and the most bits of any (32 MB).
BITS_EACH, MOST_BITS = 16, 1 << 28
#: Bits of one row of a bitmap, as ``bitmap_construct_agg`` makes it.
ROW_BITS = 32_768


def lowered(text: Column) -> Column:
    """``text`` with A-Z lower-cased; texts of ASCII only take the faster way."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


class Bitmap:
    """Which groups a scan has left: a bit for the hash of each, broadcast in rows of 32,768 bits.

    It has 16 bits a group at least, up to 32 MB in all. Beyond, more and more other texts pass, too: they are looked at in vain,
    which changes no result.
    """

    def __init__(self, groups: DataFrame, keys: list[str]):
        self.rows = table(groups.select(F.xxhash64(*keys).alias("h")), "groups")
        wanted = max(ROW_BITS, self.rows.count() * BITS_EACH)
        self.bits = min(MOST_BITS, 1 << (wanted - 1).bit_length())
        at = F.col("h").bitwiseAND(F.lit(self.bits - 1))
        maps = self.rows.groupBy(F.shiftright(at, 15).alias("_row")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(ROW_BITS - 1))).alias("_map"))
        self.maps = table(maps, "bitmap")  # at most 8,192 rows of 4 KB

    def marked(self, rows: DataFrame, name: str, *keys: Column) -> DataFrame:
        """``rows`` with the boolean ``name``: may the group of ``keys`` be one of the groups?"""
        at = F.xxhash64(*keys).bitwiseAND(F.lit(self.bits - 1))
        beside = rows.withColumns({"_at": at, "_of": F.shiftright(at, 15)}).join(F.broadcast(self.maps), F.col("_of") == F.col("_row"), "left")
        inside = F.col("_at").bitwiseAND(F.lit(ROW_BITS - 1))
        byte = F.conv(F.hex(F.substring("_map", (F.floor(inside / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("bigint")
        bit = F.getbit(byte, (inside % 8).cast("int")) == 1
        return beside.withColumn(name, F.coalesce(bit, F.lit(False))).drop("_at", "_of", "_row", "_map")

    def drop(self) -> None:
        drop(self.rows, self.maps)


def exact_copies(docs: DataFrame, keep: bool = False, digests: bool = False) -> DataFrame:
    """(doc_id, keep_id, group_size, kept) for each row of ``docs`` (doc_id, text): the doc_id of the row that stays of its group of
    equal texts, the group's rows, and whether the row itself stays, which is the one of largest doc_id.

    Null texts count as empty; all empty texts are one group. Of repeated rows of the largest doc_id one stays, whichever; a null
    doc_id comes before all others, and a group without any has a null keep_id and one row that stays. An empty table gives
    no rows. Other columns are ignored, or come along as struct ``row`` with ``keep``. With ``digests``, text_sha256 (lower-case
    hex, of the lower-cased text in UTF-8) is given for all rows, also for those that the refinement didn't have to hash.
    """
    n = F.octet_length("text")
    rows = rows_kept(docs, keep).withColumn("text", F.coalesce("text", F.lit("")))
    texts = rows.select("text")

    lengths = Bitmap(texts.groupBy(n.alias("n")).agg(F.count("*").alias("m")).where("m > 1").select("n"), ["n"])
    shared = lengths.marked(texts, "_shared", n).where("_shared")
    start = F.xxhash64(lowered(F.substring("text", 1, BEGINNING)))
    starts = shared.groupBy(n.alias("n"), start.alias("start")).agg(F.count("*").alias("m")).where("m > 1").select("n", "start")
    starts = Bitmap(starts, ["n", "start"])

    whole = F.sha2(lowered(F.col("text")), 256)
    asked = lengths.marked(rows, "_shared", n)
    asked = starts.marked(asked.withColumn("_start", F.when(F.col("_shared"), start)), "_asked", n, F.col("_start"))
    digest = [F.when(~F.col("_asked"), whole).alias("_digest")] if digests else []
    own = ["row"] if keep else []
    cards = table(asked.select("doc_id", F.when(F.col("_asked"), whole).alias("whole"), *digest, F.monotonically_increasing_id().alias("tag"), *own), "cards")
    drop(lengths.maps, starts.maps, lengths.rows, starts.rows)

    groups = cards.where("whole is not null").groupBy("whole").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", (-F.col("tag")).alias("tag"))).alias("best"))
    groups = table(groups.where("n > 1"), "copies")  # one row a group: the others are their own
    found = groups.select("whole", "n", F.col("n").alias("group_size"), F.col("best.doc_id").alias("keep_id"), (-F.col("best.tag")).alias("_tag"))
    hot = F.broadcast(found.where(F.col("n") > (most := hot_bound(cards.count()))))  # there are fewer than 10,000 such groups
    few = cards.where("whole is not null").join(hot.select("whole"), "whole", "left_anti").join(found.where(F.col("n") <= most), "whole", "left")
    many = cards.where("whole is not null").join(hot, "whole")
    alone = cards.where("whole is null").withColumns({"group_size": F.lit(1).cast("bigint"), "keep_id": F.col("doc_id"), "_tag": F.col("tag")})
    columns = ["doc_id", F.when(F.col("group_size").isNotNull(), F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size")]
    columns += [F.coalesce(F.col("_tag") == F.col("tag"), F.lit(True)).alias("kept"), *([F.coalesce("whole", "_digest").alias("text_sha256")] if digests else []), *own]
    return many.select(*columns).unionAll(few.select(*columns)).unionAll(alone.select(*columns))


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group of equal texts."""
    return exact_copies(docs, keep=True).where("kept").select("row.*")


#: DuckDB twin of the query.
COPIES_SQL = """with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size, row_number() over (partition by t order by doc_id desc) = 1 as kept, sha256(t) as text_sha256 from t"""
