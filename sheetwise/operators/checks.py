"""Rule checks. Each gives rows of check_id, severity, the page's key columns and subject.

A page is known by KEYS, its document and its number in it; no check looks beyond a page, but for those of whole documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("doc_id", "page")
#: Capital words of plan sheets that are no abbreviations.
COMMON_WORDS = """
THE AND FOR NOT ALL ARE BUT CAN HAD HAS HER HIS HOW ITS MAY NEW NOW OLD OUR OUT OWN SAY SHE TOO USE WAY WHO BOY DID GET HIM LET PUT RUN SET
TOP BIG END FAR TRY ASK MAN DAY ALSO MADE EACH BACK BEEN BOTH COME DOES DOWN EVEN FIND GIVE GOOD HAVE HERE INTO JUST KEEP KNOW LAST LIKE
LINE LIST LONG LOOK MAKE MANY MORE MOST MUCH MUST NAME NEXT ONLY OPEN OVER PART PLAN PAGE SAME SHOW SIDE SOME SUCH TAKE TELL THAN THAT THEM
THEN THIS TIME TURN TYPE UPON VERY WANT WELL WENT WERE WHAT WHEN WILL WITH WORK YEAR YOUR FROM THEY CALL SAID USED CONT NOTES NOTE SITE SEE
PER REF YES SHEET DATE SCALE PLANS STATE ROAD DRAWING GENERAL PROJECT OKLAHOMA DEPARTMENT TRANSPORTATION STANDARD DETAILS LEGEND REVISION
REVISIONS ABBREVIATIONS CONTINUED TOTAL AREA SECTION TYPICAL NORTH SOUTH EAST WEST COUNTY CITY TOWN HIGHWAY STREET AVENUE PROPOSED EXISTING
REMOVED CONSTRUCTION ENGINEER
""".split()


def _finding(df: DataFrame, check_id: str | Column, severity: str, subject, keys=KEYS) -> DataFrame:
    name = F.lit(check_id) if isinstance(check_id, str) else check_id
    return df.select(name.alias("check_id"), F.lit(severity).alias("severity"), *[F.col(k).cast("bigint").alias(k) for k in keys], F.coalesce(subject.cast("string"), F.lit("")).alias("subject"))


def union(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def _name(c: str) -> Column:
    return F.upper(F.trim(c))


def run_checks(checks: list[DataFrame], confidence: DataFrame, keys=KEYS, threshold: float = 0.6) -> DataFrame:
    """All findings, each a step less severe on pages whose mean confidence (keys and confidence) is under the threshold."""
    found = union(checks).join(confidence.select(*keys, "confidence"), list(keys), "left")
    lower = F.when(F.col("severity") == "error", "warning").when(F.col("severity") == "warning", "info").otherwise(F.col("severity"))
    return found.withColumn("severity", F.when(F.coalesce("confidence", F.lit(1.0)) < threshold, lower).otherwise(F.col("severity"))).drop("confidence")


def numbering(notes: DataFrame, keys=KEYS) -> DataFrame:
    """NOTES_DUP for each repeat, NOTES_GAP for a column that lacks numbers from 1 to its highest, NOTES_ORDER for its first fall.

    From the keys, column_ix, ord and number. Missing numbers are named as ranges between neighbours, so that a misread number costs no
    more than a row.
    """
    column = [*keys, "column_ix"]
    again = notes.withColumn("nth", F.row_number().over(Window.partitionBy(*column, "number").orderBy("ord"))).where("nth > 1")
    distinct = notes.select(*column, "number").distinct()
    low = F.coalesce(F.lag("number").over(Window.partitionBy(*column).orderBy("number")), F.lit(0)) + 1
    open_ = distinct.withColumn("low", low).withColumn("high", F.col("number") - 1).where("low <= high and number >= 1").withColumn("low", F.greatest("low", F.lit(1)))
    span = F.when(F.col("low") == F.col("high"), F.col("low").cast("string")).otherwise(F.concat_ws("-", "low", "high"))
    gaps = open_.groupBy(*column).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("low", span.alias("span")))), lambda x: x["span"]), ",").alias("missing"))
    falls = notes.withColumn("before", F.lag("number").over(Window.partitionBy(*column).orderBy("ord"))).where("number < before").groupBy(*column).agg(F.min(F.struct("ord", "number")).alias("m"))
    return union([_finding(again, "NOTES_DUP", "error", F.col("number"), keys), _finding(gaps, "NOTES_GAP", "warning", F.col("missing"), keys), _finding(falls, "NOTES_ORDER", "warning", F.col("m.number"), keys)])


def columns_without_header(columns: DataFrame, keys=KEYS) -> DataFrame:
    """NOTES_NO_HEADER: columns with notes and no header. From the keys, column_ix, header and n_notes."""
    return _finding(columns.where("(header is null or trim(header) = '') and n_notes > 0"), "NOTES_NO_HEADER", "warning", F.col("column_ix"), keys)


def undefined_references(tokens: DataFrame, notes: DataFrame, keys=KEYS) -> DataFrame:
    """NOTES_XREF: notes that a text names (SEE NOTE 7, REFER TO NOTE #7) and no column of its page defines, one for each mention; none on
    pages without notes columns."""
    named = tokens.select(*keys, F.explode(F.regexp_extract_all("text", F.lit(r"(?i)(?:SEE|REFER\s+TO)\s+NOTE\s+#?(\d+)"), F.lit(1))).alias("n")).select(*keys, F.col("n").try_cast("bigint").alias("number"))
    named = named.join(notes.select(*keys).distinct(), list(keys), "left_semi")
    known = notes.select(*keys, F.col("number").cast("bigint").alias("number")).distinct()
    return _finding(named.join(known, [*keys, "number"], "left_anti"), "NOTES_XREF", "warning", F.col("number"), keys)


def abbreviations(entries: DataFrame, keys=KEYS) -> DataFrame:
    """ABBREV_DUP: codes of a page with more than one meaning, both trimmed and in any case."""
    named = entries.select(*keys, _name("code").alias("code"), _name("meaning").alias("meaning")).where("code <> ''")
    many = named.groupBy(*keys, "code").agg(F.countDistinct("meaning").alias("n")).where("n > 1")
    return _finding(many, "ABBREV_DUP", "error", F.col("code"), keys)


def undefined_abbreviations(notes: DataFrame, entries: DataFrame, keys=KEYS) -> DataFrame:
    """ABBREV_UNDEF: capital words in a page's notes (keys and text) that are neither common nor in its table; none without a table."""
    words = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b([A-Z]{2,})\b"), F.lit(1)))).alias("code")
    used = notes.select(*keys, words).distinct().where(~F.col("code").isin(*COMMON_WORDS))
    table = entries.select(*keys, _name("code").alias("code")).distinct()
    return _finding(used.join(table.select(*keys).distinct(), list(keys), "left_semi").join(table, [*keys, "code"], "left_anti"), "ABBREV_UNDEF", "info", F.col("code"), keys)


def empty_regions(regions: DataFrame, entries: DataFrame, keys=KEYS) -> DataFrame:
    """LEGEND_EMPTY, ABBREV_EMPTY and REV_EMPTY: regions without entries, from the keys, region_ix and region_type."""
    bare = regions.join(entries.select(*keys, "region_ix").distinct(), [*keys, "region_ix"], "left_anti")
    of = lambda kind, check, severity: _finding(bare.where(F.col("region_type") == kind), check, severity, F.col("region_ix"), keys)
    return union([of("legend", "LEGEND_EMPTY", "warning"), of("abbreviation", "ABBREV_EMPTY", "info"), of("revision", "REV_EMPTY", "info")])


def legends_without_header(regions: DataFrame, entries: DataFrame, keys=KEYS) -> DataFrame:
    """LEGEND_NO_HEADER: legends with entries and no header."""
    bare = regions.where("region_type = 'legend' and (header is null or trim(header) = '')")
    return _finding(bare.join(entries.select(*keys, "region_ix").distinct(), [*keys, "region_ix"], "left_semi"), "LEGEND_NO_HEADER", "info", F.col("region_ix"), keys)


def revision_dates(revisions: DataFrame, keys=KEYS) -> DataFrame:
    """REV_DATE_ORDER: a region's first pair of dates sets the direction (rising if equal); the first date against it is reported.

    From the keys, region_ix, ord and date; entries without a date are passed over.
    """
    region = [*keys, "region_ix"]
    order = Window.partitionBy(*region).orderBy("ord")
    step = revisions.where("date is not null").withColumn("step", F.signum(F.datediff("date", F.lag("date").over(order)))).where("step is not null").withColumn("first", F.first("step").over(order))
    against = F.when(F.col("first") >= 0, F.col("step") < 0).otherwise(F.col("step") > 0)
    broken = step.where(against).groupBy(*region).agg(F.min(F.struct("ord", "date")).alias("m"))
    return _finding(broken, "REV_DATE_ORDER", "warning", F.col("m.date"), keys)


def revisions_without_number(revisions: DataFrame, keys=KEYS) -> DataFrame:
    """REV_NO_NUMBER: entries with a description or a date and no number. From the keys, ord, number, description and date."""
    has = (F.length(F.coalesce(F.trim("description"), F.lit(""))) > 0) | F.col("date").isNotNull()
    return _finding(revisions.where(has & (F.length(F.coalesce(F.trim(F.col("number").cast("string")), F.lit(""))) == 0)), "REV_NO_NUMBER", "warning", F.col("ord"), keys)


def detail_duplicates(details: DataFrame, keys=KEYS) -> DataFrame:
    """STDDET_DUP: sheet numbers of standard details that a page lists more than once, with whatever description."""
    many = details.select(*keys, _name("sheet").alias("sheet")).where("sheet <> ''").groupBy(*keys, "sheet").count().where("count > 1")
    return _finding(many, "STDDET_DUP", "warning", F.col("sheet"), keys)


def details_without_description(details: DataFrame, keys=KEYS) -> DataFrame:
    """STDDET_NO_DESC: standard details with a sheet number and no description."""
    return _finding(details.where("trim(sheet) <> '' and coalesce(trim(description), '') = ''"), "STDDET_NO_DESC", "warning", F.col("sheet"), keys)


def title_fields(pages: DataFrame, fields: DataFrame, required=("sheet_number", "date"), keys=KEYS) -> DataFrame:
    """TITLE_MISSING for pages without any field, TITLE_NO_<FIELD> for those that lack a required one."""
    bare = pages.join(fields.select(*keys).distinct(), list(keys), "left_anti")
    titled = fields.select(*keys).distinct().withColumn("label", F.explode(F.array(*[F.lit(r) for r in required])))
    lacking = titled.join(fields.where("value <> ''").select(*keys, "label"), [*keys, "label"], "left_anti")
    return union([_finding(bare, "TITLE_MISSING", "warning", F.lit(""), keys), _finding(lacking, F.concat(F.lit("TITLE_NO_"), F.upper("label")), "warning", F.col("label"), keys)])


DOCUMENT = ("doc_id",)


def duplicate_sheets(pages: DataFrame, keys=DOCUMENT) -> DataFrame:
    """DOC_DUP_SHEET: sheet numbers, trimmed and in any case, on more than one page of a document. From the keys, page and sheet."""
    many = pages.select(*keys, _name("sheet").alias("sheet")).where("sheet <> ''").groupBy(*keys, "sheet").count().where("count > 1")
    return _finding(many, "DOC_DUP_SHEET", "error", F.col("sheet"), keys)


def abbreviation_conflicts(entries: DataFrame, keys=DOCUMENT) -> DataFrame:
    """DOC_ABBREV_CONFLICT: codes with more than one meaning in a document."""
    return abbreviations(entries, keys).withColumn("check_id", F.lit("DOC_ABBREV_CONFLICT"))


def untitled_pages(pages: DataFrame, keys=DOCUMENT) -> DataFrame:
    """DOC_TITLE_INCONSISTENT: pages without a title block (sheet is null) in a document where other pages have one, one finding."""
    by = pages.groupBy(*keys).agg(F.count_if(F.col("sheet").isNull()).alias("bare"), F.count("*").alias("n"))
    return _finding(by.where("bare > 0 and bare < n"), "DOC_TITLE_INCONSISTENT", "info", F.col("bare"), keys)


def legend_conflicts(symbols: DataFrame, keys=DOCUMENT) -> DataFrame:
    """DOC_LEGEND_CONFLICT: a symbol (its kind and box as one key) with more than one description in a document."""
    named = symbols.select(*keys, "symbol", _name("description").alias("description")).where("symbol <> '' and description <> ''")
    many = named.groupBy(*keys, "symbol").agg(F.countDistinct("description").alias("n")).where("n > 1")
    return _finding(many, "DOC_LEGEND_CONFLICT", "warning", F.col("symbol"), keys)


def revision_gaps(revisions: DataFrame, keys=DOCUMENT) -> DataFrame:
    """DOC_REVISION_GAP: a document whose revision numbers lack some from 1 to the highest, one finding that names them as ranges."""
    numbers = revisions.select(*keys, F.col("number").try_cast("bigint").alias("number"), F.lit(0).alias("column_ix"), F.lit(0).alias("ord")).where("number >= 0")
    return numbering(numbers.distinct(), keys).where("check_id = 'NOTES_GAP'").withColumn("check_id", F.lit("DOC_REVISION_GAP"))


def low_quality_pages(pages: DataFrame, keys=DOCUMENT, part: float = 0.6, least: int = 3) -> DataFrame:
    """DOC_LOW_QUALITY: a document with pages under 0.6 of its mean quality, if at least three have a quality over 0; one finding, with
    how many. From the keys and quality."""
    good = pages.where("quality > 0")
    mean = good.groupBy(*keys).agg(F.avg("quality").alias("mean"), F.count("*").alias("n")).where(F.col("n") >= least)
    low = good.join(mean, list(keys)).where(F.col("quality") < part * F.col("mean")).groupBy(*keys).agg(F.count("*").alias("low"))
    return _finding(low, "DOC_LOW_QUALITY", "info", F.col("low"), keys)


def document_checks(pages: DataFrame, entries: DataFrame, symbols: DataFrame, revisions: DataFrame) -> DataFrame:
    """The six checks of whole documents."""
    return union([duplicate_sheets(pages), abbreviation_conflicts(entries), untitled_pages(pages), legend_conflicts(symbols), revision_gaps(revisions), low_quality_pages(pages)])
