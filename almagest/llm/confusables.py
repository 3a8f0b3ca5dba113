"""Text of one consistent form: visually equal texts become equal.

Values that hold a character which might only look like another are mapped
(functions.textfold): variant letters, invisible characters, spaces, look-alike
letters. What is left to differ are accents: mapped values beyond the plain
blocks are grouped in SQL by an accent-sensitive Unicode collation, to which an
accent counts the same whether it is written apart or in one character with its
letter, and in whichever order the accents of a letter are written. Each class
has a deterministic canonical member, which is joined back to the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almagest.functions.textfold import beyond_plain, compose, map_lookalikes, may_differ
from almagest.session import cut

#: Classes of mapped values. Each value brings its composed spelling as a member of its class,
#: so a class has a composed member even where no row is written so. The canonical member is the
#: one of the fewest code points, among those the first in code-point order.
CLASSES = """
    with member as (select composed, mapped as form from {odd} union select composed, composed from {odd}),
    class as (select collate(composed, 'UNICODE') as same, min(struct(length(form) as n, form)) as best from member group by collate(composed, 'UNICODE'))
    select o.mapped, c.best.form as member from {odd} o join class c on collate(o.composed, 'UNICODE') = c.same where o.mapped <> c.best.form
"""


def values(terms: DataFrame, names: DataFrame, requests: DataFrame) -> DataFrame:
    """(table_name, row_key, text) of the three tables' texts; null texts have
    no form and are left out."""
    t = terms.select(F.lit("terms").alias("table_name"), F.col("chunk_id").cast("string").alias("row_key"), "text")
    n = names.select(F.lit("names").alias("table_name"), F.col("name_key").alias("row_key"), F.col("raw_name").alias("text"))
    r = requests.select(F.lit("requests").alias("table_name"), F.col("id").cast("string").alias("row_key"), F.col("quote").alias("text"))
    return t.unionByName(n).unionByName(r).where("text is not null")


def _resolved(df: DataFrame, text: str, out: str) -> DataFrame:
    """The rows of `df` whose text may differ from its canonical form, with
    that form. The mapped rows are written once to the shared checkpoint folder
    and read for the classes and for the join."""
    m = cut(map_lookalikes(df.where(may_differ(F.col(text))), text, "__mapped"))
    odd = m.where(F.col("__mapped").rlike(beyond_plain())).select(F.col("__mapped").alias("mapped")).distinct()
    odd = cut(odd.withColumn("composed", compose(F.col("mapped"))))
    moved = df.sparkSession.sql(CLASSES, odd=odd).select(F.col("mapped").alias("__mapped"), "member")
    return m.join(moved, "__mapped", "left").withColumn(out, F.coalesce("member", "__mapped")).drop("__mapped", "member")


def canonical(df: DataFrame, text: str = "text", out: str = "canonical") -> DataFrame:
    """`df` with the canonical form of `text` as column `out`; null stays null.
    Texts without a character that might differ are their own form. An accent
    after a letter that has another one within it already stays where it is."""
    rest = df.where(~F.coalesce(may_differ(F.col(text)), F.lit(False))).withColumn(out, F.col(text))
    return rest.unionByName(_resolved(df, text, out))


def found(terms: DataFrame, names: DataFrame, requests: DataFrame) -> DataFrame:
    """(table_name, row_key) of the rows whose text is not in canonical form,
    once per key."""
    c = _resolved(values(terms, names, requests), "text", "canonical")
    return c.where(F.col("canonical") != F.col("text")).select("table_name", "row_key").distinct()
