"""Results, statuses and decisions: what a document, a unit, a statement or a decision is worth as things stand now."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.money import MONEY, normalize_currency
from .cut import checkpointed, growing

DEFAULT_CURRENCY = "MYR"
PROBLEMS_SHOWN = 100


def month_end(date: Column) -> Column:
    """A date of year and month becomes the month's last day; other texts stay."""
    month = F.try_to_timestamp(F.concat(date, F.lit("-01")), F.lit("yyyy-MM-dd")).cast("date")
    return F.when(F.regexp_like(date, F.lit(r"^\d{4}-\d{2}$")) & month.isNotNull(), F.last_day(month).cast("string")).otherwise(date)


def clean_piece(pieces: DataFrame) -> DataFrame:
    """amount (text) becomes positive cents, half up; unreadable ones stay as they are. date and currency get their defaults; adds currency_default."""
    value = F.trim(F.regexp_replace("amount", ",", "")).try_cast("decimal(38,10)")
    blank = F.coalesce(F.trim("currency"), F.lit("")) == ""
    clean = F.coalesce(F.round(F.abs(value), 2).cast("decimal(38,2)").cast("string"), F.col("amount"))
    return pieces.withColumn("amount", clean).withColumn("date", month_end(F.col("date"))).withColumn("currency_default", blank).withColumn("currency", F.when(blank, DEFAULT_CURRENCY).otherwise(normalize_currency(F.col("currency"))))


def without_zero(pieces: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The pieces that have an amount, and (key, skipped): how many of zero were left out."""
    zero = F.col("amount") == "0.00"
    return pieces.filter(~F.coalesce(zero, F.lit(False))), pieces.groupBy(key).agg(F.count_if(zero).alias("skipped")).filter("skipped > 0")


def canonical(pieces: DataFrame) -> DataFrame:
    """New fields where they are, else what older records called them; names stay empty rather than invented."""
    pick = lambda *names: F.coalesce(*[F.col(n) for n in names if n in pieces.columns], F.lit(""))
    names = {"piece_type": ("document_type",), "amount": ("total",), "document_number": ("invoice_number",), "amount_location": ("location",), "description": ("brief_description",), "payer": (), "payee": (), "currency": (), "date": ()}
    kept = [c for c in pieces.columns if c not in names and c not in {n for old in names.values() for n in old}]
    return pieces.select(*kept, *[pick(new, *old).alias(new) for new, old in names.items()])


def document_status(documents: DataFrame) -> DataFrame:
    """Adds `status`, the first that fits of: Trash, Needs attention, Queued, Processing, Needs review, Complete.

    documents: discarded, error, blocked, units, read, unreadable, assembled, pieces, reviewed (pieces reviewed).
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    status = (
        F.when(flag("discarded"), "Trash")
        .when((F.coalesce("error", F.lit("")) != "") | flag("blocked"), "Needs attention")
        .when(F.col("read") < F.col("units"), F.when(F.col("read") > 0, "Processing").otherwise("Queued"))
        .when(flag("unreadable"), "Needs attention")
        .when((F.col("units") > 1) & ~flag("assembled"), "Processing")
        .when((F.col("pieces") == 0) | (F.col("reviewed") < F.col("pieces")), "Needs review")
        .otherwise("Complete")
    )
    return documents.withColumn("status", status)


def document_category(duplicate: Column, status: Column) -> Column:
    return F.when(duplicate | (status == "Trash"), "excluded").when(status == "Complete", "complete").when(status == "Needs attention", "attention").otherwise("review")


def inventory_status(documents: DataFrame) -> DataFrame:
    """Adds `state` to (accepted, error, keeper, blocked, unreadable, units, read): what the inventory says of a document."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    state = (
        F.when(~F.coalesce("accepted", F.lit(True)), "not_accepted")
        .when(F.coalesce("error", F.lit("")) != "", "unresolved")
        .when(F.col("keeper").isNotNull(), "confirmed_duplicate")
        .when(flag("blocked") | flag("unreadable"), "unresolved")
        .when(F.col("read") < F.col("units"), "extraction_pending")
        .otherwise("extracted")
    )
    return documents.withColumn("state", state)


def stage_steps(stages: DataFrame, project: str) -> DataFrame:
    """Adds `next` to (project, number, name, done): the stage after a done one, if all before it are done too."""
    w = Window.partitionBy(project).orderBy("number")
    before = F.coalesce(F.bool_and("done").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    return stages.withColumn("next", F.when(F.col("done") & before, F.lead("name").over(w)))


def decision_staleness(banks: DataFrame, decisions: DataFrame, allocations: DataFrame, items: DataFrame) -> DataFrame:
    """Rows (bank_id, report_index, stale): whether a line or anything its decision rests on has changed since.

    banks: bank_id, source_hash (now), recorded_hash, revision. decisions: bank_id, bank_revision. allocations: bank_id,
    item_id, revision. items: item_id, revision, excluded, retired, document_hash (now), document. The index counts all
    lines in their order, so it survives later filters; it is numbered by a sort over ranges, not in one task.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    gone = flag("retired") | flag("excluded") | ~F.col("document_hash").eqNullSafe(F.col("document"))
    state = items.select("item_id", gone.alias("gone"), F.col("revision").alias("now"))
    moved = allocations.join(state, "item_id", "left").groupBy("bank_id").agg(F.bool_or(F.coalesce("gone", F.lit(True)) | ~F.col("revision").eqNullSafe(F.col("now"))).alias("moved"))
    rows = banks.join(decisions.select("bank_id", "bank_revision", F.lit(True).alias("decided")), "bank_id", "left").join(moved, "bank_id", "left")
    changed = ~F.col("source_hash").eqNullSafe(F.col("recorded_hash"))
    stale = changed | (flag("decided") & (flag("moved") | ~F.col("bank_revision").eqNullSafe(F.col("revision"))))
    return global_number(rows.select("bank_id", stale.alias("stale")), "bank_id", "report_index")


def global_number(rows: DataFrame, order: str, name: str) -> DataFrame:
    """One-based number in the order of a distinct column: numbers inside ranges plus the counts of the ranges before.

    The sorted ranges are written once, with the number of the range and the place in it, so that counts and rows are
    of the same ranges.
    """
    dealt = checkpointed(rows.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("_id", F.monotonically_increasing_id()))
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = dealt.groupBy(part.alias("_part")).count()  # one row a range
    before = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_before"))
    return dealt.withColumn("_part", part).withColumn(name, place).join(starts, "_part").withColumn(name, F.col(name) + F.col("_before") + 1).drop("_part", "_before", "_id")


def review_optional(level: Column, stale: Column, live: Column, saved: Column) -> Column:
    """Only a current, finished result without a match may go without a human decision."""
    return F.coalesce(level, F.lit("none")).isin("none") & ~F.coalesce(stale, F.lit(False)) & (~live | F.coalesce(saved, F.lit(False)))


def transaction_values(banks: DataFrame) -> DataFrame:
    """Typed fields of a report line: zero sides are blank, lines without a party ask for one."""
    party = F.nullif(F.upper("counterparty"), F.lit(""))
    side = lambda c: F.nullif(F.col(c).cast(MONEY), F.lit(0).cast(MONEY)).alias(c)
    return banks.select("bank_id", F.col("date").cast("date").alias("date"), party.alias("counterparty"), side("money_in"), side("money_out"), F.col("balance").cast(MONEY).alias("balance"), F.when(party.isNotNull(), "PENDING").otherwise("REVIEW PAY TO").alias("status"))


def related_lines(choices: DataFrame, items: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows (bank_id, document): lines outside the batch whose candidates touch a document of the batch's candidates."""
    touched = choices.join(items.select("item_id", "document"), "item_id").select("bank_id", "document").distinct()
    documents = touched.join(batch, "bank_id", "left_semi").select("document").distinct()
    return touched.join(batch, "bank_id", "left_anti").join(documents, "document", "left_semi")


def competing_lines(choices: DataFrame) -> DataFrame:
    """Rows (item_id, lines): how many lines list each candidate; the lines themselves stay rows of choices."""
    return choices.select("item_id", "bank_id").distinct().groupBy("item_id").agg(F.count("*").alias("lines"))


def competing_facts(choices: DataFrame, banks: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows (item_id, facts of banks): every line that lists a candidate of the batch's lines, those of the batch too.

    banks: bank_id and what the other side shows of a line, such as amount, parties, references, description. A candidate that very many lines list
    gives as many rows, none of them long.
    """
    listed = choices.select("item_id", "bank_id").distinct()
    selected = listed.join(batch.select("bank_id").distinct(), "bank_id", "left_semi").select("item_id").distinct()
    return listed.join(selected, "item_id", "left_semi").join(banks, "bank_id").select("item_id", *banks.columns)


def report_checks(proposals: DataFrame, banks: DataFrame, items: DataFrame) -> DataFrame:
    """Rows (bank_id, assessment, problem) after the checks over all lines; each looks at what the one before left strong.

    proposals: bank_id, assessment, item_id, amount. A strong line must explain its amount to the cent with pieces of its
    own currency and known amounts; pieces must not be promised beyond their amount; and a document whose boundaries are
    unresolved serves one line only.
    """
    facts = items.select("item_id", F.col("amount").alias("capacity"), F.col("currency").alias("item_currency"), "document", F.coalesce("boundary_unresolved", F.lit(False)).alias("open"))
    rows = proposals.join(banks.select("bank_id", "bank_amount", F.col("currency").alias("bank_currency")), "bank_id").join(facts, "item_id", "left")
    wrong = F.col("item_id").isNotNull() & (F.col("item_currency").isNull() | (F.col("item_currency") != F.col("bank_currency")) | F.col("capacity").isNull())
    line = rows.groupBy("bank_id").agg(F.first("assessment").alias("assessment"), F.first("bank_amount").alias("bank_amount"), F.coalesce(F.sum("amount"), F.lit(0)).cast(MONEY).alias("total"), F.bool_or(wrong).alias("wrong"))
    one = line.withColumn("problem", F.when((F.col("assessment") == "strong") & ((F.col("total") != F.col("bank_amount")) | F.col("wrong")), "amount difference or missing facts"))
    strong = rows.join(one.filter("assessment = 'strong' and problem is null").select("bank_id"), "bank_id", "left_semi").filter("item_id is not null")
    over = strong.groupBy("item_id").agg(F.sum("amount").alias("promised"), F.first("capacity").alias("capacity")).filter("promised > capacity").select("item_id")
    two = strong.join(over, "item_id", "left_semi").select("bank_id").distinct().withColumn("over", F.lit(True))
    left = strong.join(two, "bank_id", "left_anti").filter("open")
    shared = left.groupBy("document").agg((F.min("bank_id") != F.max("bank_id")).alias("many")).filter("many").select("document")
    three = left.join(shared, "document", "left_semi").select("bank_id").distinct().withColumn("shared", F.lit(True))
    out = one.join(two, "bank_id", "left").join(three, "bank_id", "left")
    problem = F.coalesce("problem", F.when(F.col("over"), "competing payments exceed the piece"), F.when(F.col("shared"), "several payments use an unassembled source"))
    return out.select("bank_id", F.when(problem.isNotNull(), "tentative").otherwise(F.col("assessment")).alias("assessment"), problem.alias("problem"))


def assembly_failures(assemblies: DataFrame) -> DataFrame:
    """Adds `failure` to (expected array, reviewed array, receipts array<array>): the first rule that an assembly breaks."""
    repeats = lambda a: F.size(a) != F.size(F.array_distinct(a))
    unknown = lambda a: F.size(F.array_except(a, F.col("expected"))) > 0
    failure = (
        F.when(repeats(F.col("reviewed")), "repeats a reviewed unit")
        .when(unknown(F.col("reviewed")) | (F.size(F.array_except("expected", "reviewed")) > 0), "did not review every unit")
        .when(F.exists("receipts", repeats), "receipt repeats a unit")
        .when(F.exists("receipts", unknown), "receipt of an unknown unit")
    )
    return assemblies.withColumn("failure", failure)


def revision(*columns: Column) -> Column:
    """A hash over values with their borders and unknown ones kept apart."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns]), 256)


def current_assemblies(assemblies: DataFrame, units: DataFrame) -> DataFrame:
    """The assemblies (document, input_revision) whose inputs, all results (document, unit_no, result) of the document, are still the same."""
    now = units.groupBy("document").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("unit_no", "result"))), lambda u: F.concat_ws("\x1f", u["unit_no"], F.coalesce(u["result"], F.lit("")))), "\x1e"), 256).alias("input_revision"))
    return assemblies.join(now, ["document", "input_revision"], "left_semi")


def row_drift(saved: DataFrame, fresh: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Rows (key, column, saved, fresh) where saved and newly read rows differ, unknown values counting as values; rows of one side only differ in all."""
    a, b = saved.select(*key, F.struct(*columns).alias("a")), fresh.select(*key, F.struct(*columns).alias("b"))
    both = a.join(b, key, "full_outer")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a.`{c}`").cast("string").alias("saved"), F.col(f"b.`{c}`").cast("string").alias("fresh")) for c in columns])
    return both.select(*key, F.explode(F.filter(cells, lambda x: ~x["saved"].eqNullSafe(x["fresh"]))).alias("d")).select(*key, "d.*")


def recovered(rows: DataFrame, original: DataFrame, key: str, identity: list[str], fields: list[str]) -> DataFrame:
    """Blank fields from an original, but only if every row is in it with the same identity columns."""
    own = original.select(key, *[F.col(c).alias(f"_{c}") for c in [*identity, *fields]], F.lit(True).alias("_there"))
    met = rows.join(own, key, "left")
    agrees = F.coalesce(F.col("_there"), F.lit(False))
    for c in identity:
        agrees = agrees & F.col(c).eqNullSafe(F.col(f"_{c}"))
    verdict = met.agg(F.bool_and(agrees).alias("_whole"))  # one row
    out = met.crossJoin(F.broadcast(verdict))
    for c in fields:
        blank = F.col(c).isNull() | (F.col(c).cast("string") == "")
        out = out.withColumn(c, F.when(blank & F.col("_whole"), F.col(f"_{c}")).otherwise(F.col(c)))
    return out.select(*rows.columns)


def with_retired(current: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """Current pieces, and those of history that are current no more, marked as retired."""
    old = history.join(current.select(key), key, "left_anti").withColumn("retired", F.lit(True))
    return current.withColumn("retired", F.lit(False)).unionByName(old, allowMissingColumns=True)


def followed_up(first: DataFrame, second: DataFrame) -> DataFrame:
    """A second opinion counts where the first is not strong and the second is not none: such lines become tentative."""
    other = second.select("bank_id", F.col("assessment").alias("_second"))
    takes = F.coalesce((F.col("_second") != "none") & (F.col("assessment") != "strong"), F.lit(False))
    return first.join(other, "bank_id", "left").withColumn("followed", takes).withColumn("assessment", F.when(takes, "tentative").otherwise(F.col("assessment"))).drop("_second")


def page_groups(units: DataFrame, most: int) -> DataFrame:
    """Adds `page_group` to (document, page): consecutive physical pages, at most so many a group; parts of a page stay together."""
    rank = F.dense_rank().over(Window.partitionBy("document").orderBy("page"))
    return units.withColumn("page_group", F.floor((rank - 1) / most).cast("int"))


def natural_key(name: Column, width: int = 20) -> Column:
    """A text that sorts as people expect: runs of digits compare as numbers."""
    padded = F.transform(F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), 1), lambda x: F.when(F.regexp_like(x, F.lit(r"^\d")), F.lpad(x, F.greatest(F.length(x), F.lit(width)), F.lit("0"))).otherwise(x))
    return F.array_join(padded, "")


def matches_search(query: str, *columns: str) -> Column:
    """The query, in small letters, stands in the columns joined by spaces; unknown ones are left out."""
    return F.contains(F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns])), F.lit(query.lower()))


def shown_problems(problems: DataFrame, order: list[str], most: int = PROBLEMS_SHOWN) -> tuple[DataFrame, DataFrame]:
    """The first problems of a report, and how many there are in all."""
    return problems.orderBy(*order).limit(most), problems.agg(F.count("*").alias("problems"))


def conflicting_hashes(statements: DataFrame) -> DataFrame:
    """Paths (path, hash) that stand with more than one hash."""
    return statements.groupBy("path").agg(F.count_distinct("hash").alias("hashes")).filter("hashes > 1")


def clashing_names(names: DataFrame) -> DataFrame:
    """Names that an archive which ignores case could not hold together."""
    return names.groupBy(F.lower("name").alias("name")).agg(F.count("*").alias("entries")).filter("entries > 1")


def folder_name(index: Column, party: Column) -> Column:
    """A folder of at most 100 characters of the party, with what file systems forbid replaced."""
    clean = F.regexp_replace(party, r'[<>:"/\\|?*\x00-\x1f]', "-")
    cut = F.rtrim(F.substring(F.btrim(clean, F.lit(" .")), 1, 100), F.lit(" ."))
    return F.concat_ws("-", index.cast("string"), F.when(cut == "", "Transaction").otherwise(F.coalesce(cut, F.lit("Transaction"))))


def portable_path(path: Column) -> Column:
    """Whether an archive can hold the path anywhere: no dots alone, backslashes or colons in a part."""
    return F.forall(F.split(path, "/"), lambda p: ~p.isin("..", ".") & ~F.regexp_like(p, F.lit(r"[\\:]")))


def column_number(letters: Column) -> Column:
    """A=1, Z=26, AA=27."""
    return F.aggregate(F.split(F.upper(letters), ""), F.lit(0).cast("bigint"), lambda n, c: F.when(c == "", n).otherwise(n * 26 + F.ascii(c) - 64))


def sampled(text: Column, one_in: int = 10) -> Column:
    """A fixed one in ten of texts, by their hash."""
    return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint"), F.lit(one_in)) == 0


def page_route(mode: Column, reasons: Column, approved: Column, text: Column) -> Column:
    """text where nothing speaks against it; vision for risky pages, layouts nobody approved, comparisons and the audit sample."""
    risky = (F.size(reasons) > 0) | ((mode == "hybrid") & ~F.coalesce(approved, F.lit(False)))
    return F.when(risky | (mode == "compare") | sampled(text), "vision").otherwise("text")


def evidence_problems(values: DataFrame, words: DataFrame) -> DataFrame:
    """Extracted values (document, value) that are no whole word (document, word) of their page."""
    return values.join(words.select("document", F.col("word").alias("value")).distinct(), ["document", "value"], "left_anti")


# Fixed values.
TOTAL_ROLES, TOTAL_LABELS = ["grand_total", "invoice_total"], ["total", "grand_total", "invoice_total"]
STRIPPED = " :;()"


def page_errors(results: DataFrame, words: DataFrame, key: str = "page") -> DataFrame:
    """Rows (key, errors): what keeps the text of a page from standing for its image, sorted; no errors give an empty array.

    results: key, readable, limitations, review_warnings (arrays), receipts array<struct<document_type, total, currency, invoice_numbers, limitations>>,
    money array<struct<role, amount, currency>>, totals array<struct<label, amount, currency>>. words: key, text. A receipt's total, currency and invoice
    numbers must each be a whole word of the page, with STRIPPED around it left out.
    """
    many = lambda c: F.coalesce(F.size(c), F.lit(0))
    receipts = F.coalesce("receipts", F.array().cast(results.schema["receipts"].dataType))
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    pair = lambda x: F.struct(x["amount"].alias("amount"), x["currency"].alias("currency"))
    by_role = F.transform(F.filter("money", lambda m: m["role"].isin(TOTAL_ROLES)), pair)
    by_label = F.transform(F.filter("totals", lambda t: F.replace(F.lower(t["label"]), F.lit(" "), F.lit("_")).isin(TOTAL_LABELS)), pair)
    none = F.array().cast("array<struct<amount:string,currency:string>>")
    found = F.array_distinct(F.concat(F.coalesce(by_role, none), F.coalesce(by_label, none)))
    uncertain = ~F.coalesce("readable", F.lit(False)) | F.exists(receipts, lambda r: ~r["document_type"].eqNullSafe(F.lit("receipt"))) | (many("limitations") > 0) | (many("review_warnings") > 0)
    incomplete = F.exists(receipts, lambda r: (many(r["limitations"]) > 0) | blank(r["total"]) | blank(r["currency"]))
    own = F.array_compact(F.array(
        F.when(uncertain, "uncertain_text_extraction"), F.when(F.size(receipts) != 1, "ambiguous_receipt_boundaries"), F.when(F.size(found) > 1, "conflicting_totals_or_currencies"), F.when(incomplete, "incomplete_receipt")))
    cell = lambda field, value: F.struct(field.alias("field"), value.alias("value"))
    numbers = lambda r: F.transform(F.coalesce(r["invoice_numbers"], F.array().cast("array<string>")), lambda v, n: cell(F.concat(F.lit("invoice_"), n.cast("string")), v))
    cells = F.flatten(F.transform(receipts, lambda r: F.concat(F.array(cell(F.lit("total"), r["total"]), cell(F.lit("currency"), r["currency"])), numbers(r))))
    printed = words.groupBy(key).agg(F.collect_set(F.btrim("text", F.lit(STRIPPED))).alias("printed"))  # of one page
    both = results.select(key, own.alias("own"), F.filter(cells, lambda c: ~blank(c["value"])).alias("cells")).join(growing(printed), key, "left")
    lacking = F.filter("cells", lambda c: ~F.array_contains(F.coalesce("printed", F.array().cast("array<string>")), c["value"]))
    return both.select(key, F.array_sort(F.array_distinct(F.concat("own", F.transform(lacking, lambda c: F.concat(F.lit("unsupported_"), c["field"]))))).alias("errors"))


def resumable(requests: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (key, request_revision) whose saved result is of the same revision, and those to be made again."""
    done = requests.join(results.select("key", "request_revision", "result"), ["key", "request_revision"])
    return done, requests.join(results.select("key", "request_revision"), ["key", "request_revision"], "left_anti")


def latest_state(events: DataFrame, key: str) -> DataFrame:
    """Of events (key, version, kind, value), the value in force: the latest wins, an undo leaves none."""
    last = events.groupBy(key).agg(F.max_by(F.struct("kind", "value"), "version").alias("e"), F.max("version").alias("version"))
    return last.select(key, "version", F.when(F.col("e.kind") != "undo", F.col("e.value")).alias("value"))


def overridden(rows: DataFrame, overrides: DataFrame, key: str, column: str) -> DataFrame:
    """A saved description (key, revision, value) replaces the row's as long as the row has the revision it was written for."""
    own = overrides.select(key, F.col("revision").alias("_revision"), F.col("value").alias("_value"))
    holds = F.coalesce(F.col("revision") == F.col("_revision"), F.lit(False))
    return rows.join(own, key, "left").withColumn("overridden", holds).withColumn(column, F.when(holds, F.col("_value")).otherwise(F.col(column))).drop("_revision", "_value")


def batch_sizes(choices: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows (batch, lines, documents, chars): what a batch sends; each document counts once however many lines list it."""
    lines = choices.groupBy("batch").agg(F.count_distinct("bank_id").alias("lines"))
    once = choices.select("batch", "document").distinct().join(documents.select("document", "chars"), "document")
    return lines.join(once.groupBy("batch").agg(F.count("*").alias("documents"), F.sum("chars").alias("chars")), "batch")


def stratified(rows: DataFrame, stratum: str, quotas: dict[str, int], total: int, order: Column) -> DataFrame:
    """So many of each stratum in the order given, then the next of any stratum until the total is reached."""
    wanted = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(order))
    marked = rows.withColumn("_place", place).filter(F.col("_place") <= total)
    first = marked.filter(F.col("_place") <= F.coalesce(F.try_element_at(wanted, F.col(stratum)), F.lit(0)))
    rest = marked.filter(F.col("_place") > F.coalesce(F.try_element_at(wanted, F.col(stratum)), F.lit(0)))
    both = first.withColumn("_turn", F.lit(0)).unionByName(rest.withColumn("_turn", F.lit(1)))  # at most strata x total rows
    return both.orderBy("_turn", order).limit(total).drop("_place", "_turn")


def opening_balances(rows: DataFrame, printed: DataFrame) -> DataFrame:
    """(source, opening, n_rows, printed_rows, agrees): the balance before the first row of (source, sequence, money_in,
    money_out, balance), and whether there are as many rows as (source, printed_rows) says. No printed number: no verdict."""
    zero = F.lit(0).cast(MONEY)
    before = F.col("balance") - F.coalesce("money_in", zero) + F.coalesce("money_out", zero)
    found = rows.groupBy("source").agg(F.min_by(before, "sequence").alias("opening"), F.count("*").alias("n_rows"))
    return found.join(printed, "source", "left").withColumn("agrees", F.col("n_rows") == F.col("printed_rows"))


def approved_originals(allocations: DataFrame, originals: DataFrame) -> DataFrame:
    """(bank_id, document, path) of approved allocations, once each; a document may stand in the folders of several lines."""
    return allocations.filter("approved").select("bank_id", "document").distinct().join(originals, "document").select("bank_id", "document", "path")


def extraction_coverage(units: DataFrame) -> DataFrame:
    """(document, units, unread, complete): complete if every unit of the document was read."""
    was_read = F.coalesce(F.col("was_read"), F.lit(False))
    return units.groupBy("document").agg(F.count("*").alias("units"), F.count_if(~was_read).alias("unread"), F.bool_and(was_read).alias("complete"))
