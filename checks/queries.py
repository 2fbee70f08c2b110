"""One query per operator, over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixtures
from glossmill.config import SKIP_PATTERNS, JobConfig
from glossmill.functions.comments import strip_comments
from glossmill.functions.languages import SCOPES, detect_language, extension
from glossmill.functions.lines import is_declaration
from glossmill.functions.text import (
    decode_utf8,
    js_trim,
    normalise_blank_lines,
    strip_code_fences,
    utf16_length,
)
from glossmill.operators import chunks as chunking
from glossmill.operators import diff, edits, requests, responses, review, select, store, summary
from glossmill.plans import document
from glossmill.plans.strip import strip_corpus, strip_results
from glossmill.sources import sinks, source_tree, tree
from glossmill.sources.tables import source_files
from glossmill.sources.workspace import keep, work_dir
from glossmill.streaming.assemble import assemble_available
from glossmill.streaming.strip import strip_arriving

CONFIG = JobConfig()
GLOBS = ("node_mod*", "d?st", "src1", "{src7,src8}", "repo/src[23]")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, source, path, content)``."""
    _table(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    return spark.sql(fixtures.SOURCE_FILES).withColumn("source", F.split_part("path", F.lit("/"), F.lit(2)))


def _planned(spark: SparkSession, sf_dir: str, content: str = "content") -> DataFrame:
    return document.plan_files(_files(spark, sf_dir).withColumn("content", F.expr(content)))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = select.not_blank(_planned(spark, sf_dir, fixtures.SOME_BLANK))
    return chunking.chunks(planned, CONFIG.min_lines, "doc_id", "language", "source")


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select(
        "path", "chunk_index", F.expr(fixtures.OUTPUT).alias("output"), F.expr(fixtures.ERROR).alias("error")
    )


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    _table(spark, sf_dir, "conversations").createOrReplaceTempView("conversations")
    return spark.sql(fixtures.PAIRS)


# Sources and selection


def detect_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select(
        "path",
        extension(F.col("path")).alias("extension"),
        detect_language(F.col("path")).alias("language"),
        detect_language(F.col("path"), F.expr(fixtures.OPENED_AS)).alias("opened_language"),
    )


def decode_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit(b"\xef\xbb\xbf"), F.encode("content", "UTF-8"), F.lit(b"\xe2\x82"), F.lit(b"a\xff"))
    files = _files(spark, sf_dir).select("path", raw.alias("raw"))
    return files.select("path", decode_utf8(F.col("raw")).alias("content"))


def skip_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select(
        "path",
        select.in_skipped_folder(F.col("path"), SKIP_PATTERNS).alias("skipped"),
        select.in_skipped_folder(F.col("path"), GLOBS).alias("skipped_by_glob"),
    )


def scan_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.select_files(source_files(_files(spark, sf_dir))).select("path", "language")


def scan_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.ordered(scan_select(spark, sf_dir))


def scan_ordered_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.ordered(scan_select(spark, sf_dir), 100)


def language_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = source_files(_files(spark, sf_dir))
    scopes = [F.coalesce(select.supported(F.col("language"), s), F.lit(False)).alias(s) for s in SCOPES]
    return files.select("path", "language", *scopes)


def not_blank_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.not_blank(_planned(spark, sf_dir, fixtures.SOME_BLANK)).select("path", "language")


def plan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.plan_summary(scan_select(spark, sf_dir))


def scan_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written as a tree by ``write_tree``, listed and read back."""
    root = work_dir(spark, "tree")
    sinks.write_tree(_files(spark, sf_dir), root)
    return tree.scan_tree(spark, root).select("path", "language", "content", "read_error")


def _committed(spark: SparkSession, sf_dir: str) -> str:
    root = work_dir(spark, "tree")
    source_tree.commit_tree(_files(spark, sf_dir), root)
    return root


def commit_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and sizes of files that were written with a commit."""
    return source_tree.list_names(spark, _committed(spark, sf_dir))


def scan_source_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data source, with filters that it applies to names."""
    files = source_tree.open_tree(spark, _committed(spark, sf_dir))
    return files.where("extension in ('js', 'py', 'htm', 'html', 'scss') and language <> 'python' and path like 'repo/src%'")


def write_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sink's own results; an absolute path is refused."""
    files = _files(spark, sf_dir).withColumn("path", F.expr("case when doc_id % 29 = 0 then '/' || path else path end"))
    return sinks.write_tree(files, work_dir(spark, "tree"))


def write_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stripped files written by language and read back."""
    target = work_dir(spark, "files")
    sinks.write_table(strip_corpus(_files(spark, sf_dir), mode="regex"), target)
    return spark.read.parquet(target).select("path", F.col("language").cast("string"), "content")


# Text


def _stripped(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    stripped = strip_corpus(_files(spark, sf_dir), mode=mode, scope="strip_file")
    return stripped.select("path", "language", "content")


def strip_comments_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stripped(spark, sf_dir, "regex")


def strip_comments_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stripped(spark, sf_dir, "lexical")


def strip_docstrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = select.select_files(source_files(_files(spark, sf_dir))).where("language = 'python'")
    return files.select(
        "path", strip_comments(F.col("content"), F.col("language"), docstrings=True).alias("content")
    )


def pages_strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select(
        "page_id", strip_comments(F.col("html"), F.lit("html"), "regex").alias("html")
    )


def blank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    spaced = F.expr(fixtures.SPACED)
    return _table(spark, sf_dir, "documents").select("doc_id", normalise_blank_lines(spaced).alias("text"))


def trim_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    trimmed = js_trim(F.expr(fixtures.SPACED))
    return _table(spark, sf_dir, "documents").select(
        "doc_id", trimmed.alias("text"), utf16_length(trimmed).alias("utf16_units")
    )


def strip_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = _responses(spark, sf_dir).where(F.col("output").isNotNull())
    return answers.select("path", "chunk_index", strip_code_fences(F.col("output")).alias("output"))


# Chunks


def file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.file_lines(_planned(spark, sf_dir))


def declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = chunking.file_lines(_planned(spark, sf_dir))
    return lines.where(is_declaration(F.col("line"))).select("path", "line_index")


def find_break_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.break_points(_planned(spark, sf_dir))


def chunk_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunks(_planned(spark, sf_dir), CONFIG.min_lines)


def chunk_within_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As few chunks of a hundred lines at most as can be."""
    return chunking.chunks(_planned(spark, sf_dir), CONFIG.min_lines, max_lines=100)


def chunk_rejoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.rejoin(chunk_files(spark, sf_dir))


# Requests and responses


def build_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests as one run sends them, the messages as JSON."""
    built = document.corpus_requests(_planned(spark, sf_dir, fixtures.SOME_BLANK))
    return built.withColumn("messages", F.to_json("messages"))


def request_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every provider, style and kind of override, one unknown provider too."""
    built = requests.build_requests(
        _chunks(spark, sf_dir),
        CONFIG,
        provider=F.expr(fixtures.PROVIDER),
        style=F.expr(fixtures.STYLE),
        model=F.expr(fixtures.OVERRIDE),
    )
    return built.withColumn("messages", F.to_json("messages"))


def resolve_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    provider = F.expr(fixtures.PROVIDER)
    files = _files(spark, sf_dir)
    return files.select(
        "path", provider.alias("provider"), requests.resolve_model(provider, F.expr(fixtures.OVERRIDE)).alias("model")
    )


def normalise_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = F.concat(F.lit("\n \xa0"), F.col("output"), F.lit("\t\ufeff\n"))
    return _responses(spark, sf_dir).select(
        "path", "chunk_index", responses.normalise_output(padded).alias("output")
    )


def file_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses.file_results(_responses(spark, sf_dir))


def generate_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = requests.build_requests(chunking.deal(_chunks(spark, sf_dir)), CONFIG)

    def answer(batch: object) -> list[str]:
        out = []
        for user in batch["user"]:
            if "/* file src3 */" in user:
                raise ValueError("refused")
            out.append(f"```\n{len(user)} characters\n```")
        return out

    return keep(responses.generate(built, answer, batch_size=8), "responses")


def ask_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over one store: the second sends only what the first got no answer to."""

    def answer(batch: object) -> list[str]:
        if any("/* file src3 */" in user for user in batch["user"]):
            raise ValueError("refused")
        return [f"```\n{len(user)} characters\n```" for user in batch["user"]]

    def refuse(batch: object) -> list[str]:
        raise ValueError("refused")

    built = requests.build_requests(_chunks(spark, sf_dir), CONFIG)
    answers = work_dir(spark, "answers")
    store.ask(built, answer, answers)
    return store.ask(built, refuse, answers)


def _document(spark: SparkSession, sf_dir: str, config: JobConfig) -> DataFrame:
    planned = _planned(spark, sf_dir, fixtures.SOME_BLANK)
    return document.document_corpus(planned, _responses(spark, sf_dir), config)


def document_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _document(spark, sf_dir, CONFIG)


def document_corpus_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fences taken off each chunk, and each chunk's own edges put back."""
    return _document(spark, sf_dir, JobConfig(per_chunk_fences=True, preserve_edges=True, guard_ratio=None))


def review_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = _planned(spark, sf_dir, fixtures.SOME_BLANK)
    return document.review_corpus(planned, _responses(spark, sf_dir)).drop("before", "after")


def document_arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose responses arrive on a stream, those that have an answer to every chunk."""
    landing, target = work_dir(spark, "landing"), work_dir(spark, "documented")
    answers = keep(_responses(spark, sf_dir), "responses")
    for part in (0, 1):
        answers.where(F.pmod("chunk_index", F.lit(2)) == part).write.mode("append").parquet(landing)
    planned = _planned(spark, sf_dir, fixtures.SOME_BLANK)
    assemble_available(planned, landing, target, work_dir(spark, "progress"), CONFIG, files_per_batch=8)
    return spark.read.schema(document.document_corpus(planned, answers).schema).parquet(target)


def document_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole run with a stand-in model: its one-row summary."""

    def answer(batch: object) -> list[str]:
        out = []
        for user in batch["user"]:
            if "/* file src3 */" in user:
                raise ValueError("refused")
            out.append("// documented\n" + user)
        return out

    files = _files(spark, sf_dir).withColumn("content", F.expr(fixtures.SOME_BLANK))
    done = document.run_corpus(files, answer, work_dir(spark, "run"))
    return done.withColumn("messages", F.array_join("messages", "\n"))


# Edits and review


def _spans(files: DataFrame) -> DataFrame:
    return files.select(
        "path", F.explode(F.sequence(F.lit(1), F.expr(f"cast({fixtures.SPAN_COUNT} as int)"))).alias("i")
    ).select(
        "path",
        (F.col("i") * 10).alias("start"),
        (F.col("i") * 10 + 3).alias("end"),
        # One span in 29 has no replacement.
        F.when(F.col("i") % 29 != 0, F.concat(F.lit("<"), F.col("i").cast("string"), F.lit(">"))).alias("replacement"),
    )


def apply_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _planned(spark, sf_dir)
    return edits.apply_spans(files, _spans(files))


def apply_spans_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits in the files of one language."""
    files = _planned(spark, sf_dir)
    return edits.apply_spans(files, _spans(files.where("language = 'scss'")), sparse=True)


def _selections(files: DataFrame) -> DataFrame:
    """Two selections per file, cut to its length; some are empty."""
    size = F.length("content")
    start = F.explode(F.array(F.lit(5), F.least(F.lit(70), size))).alias("start")
    chosen = files.select("doc_id", "path", size.alias("size"), start)
    width = F.when((F.col("doc_id") % 3 == 0) & (F.col("start") != 5), 0).otherwise(55)
    return chosen.select("path", "start", F.least(F.col("start") + width, F.col("size")).alias("end"))


def selection_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _planned(spark, sf_dir)
    return edits.extract_selections(files, _selections(files), "language")


def selection_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _planned(spark, sf_dir)
    picked = edits.extract_selections(files, _selections(files))
    marked = F.concat(F.lit("<<"), F.col("text"), F.lit(">>"))
    return edits.replace_selections(files, picked.withColumn("text", marked))


def selection_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _planned(spark, sf_dir)
    built = document.selection_requests(files, _selections(files))
    return built.withColumn("messages", F.to_json("messages"))


def document_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _planned(spark, sf_dir)
    selections = _selections(files)
    answers = edits.extract_selections(files, selections, "doc_id").select(
        "path",
        F.col("start").alias("chunk_index"),
        F.expr(
            "case when doc_id % 17 = 0 then null when doc_id % 7 = 0 then substr(text, 1, 20) "
            "else '```' || chr(10) || '// note' || chr(10) || text || chr(10) || '```' end"
        ).alias("output"),
        F.expr("case when doc_id % 17 = 0 then 'failed' end").alias("error"),
    )
    return document.document_selections(files, selections, answers)


def length_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = review.guarded(_pairs(spark, sf_dir), 0.5).withColumnRenamed("accepted", "file_accepted")
    judged = review.guarded(judged, 0.7).withColumnRenamed("accepted", "selection_accepted")
    return judged.select("conv_id", "turn", "file_accepted", "selection_accepted")


def review_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.review(_pairs(spark, sf_dir)).drop("before", "after")


def review_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stripping comments changes in each file."""
    files = select.select_files(source_files(_files(spark, sf_dir)), "strip_file")
    after = strip_comments(F.col("content"), F.col("language"), "regex")
    pairs = files.select("path", F.col("content").alias("before"), after.alias("after"))
    return review.review(pairs).drop("before", "after")


def preservation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _planned(spark, sf_dir).select(
        "path", "language", F.col("content").alias("before"), F.expr(fixtures.AFTER).alias("after")
    )
    return review.preservation_audit(pairs).drop("before", "after")


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planned(spark, sf_dir).select("path", "doc_id", "language", F.col("content").alias("before"), F.expr(fixtures.AFTER).alias("after"))


def review_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hunks of every changed file, summed up."""
    found = diff.hunks(_audited(spark, sf_dir))
    net = F.sum(F.col("lines_added") - F.col("lines_removed")).alias("lines_more")
    return found.groupBy("path").agg(net, F.sum(F.length("replacement") - F.length("removed")).alias("characters_more"))


def approve_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hunks of two files in three are approved, and none of the others."""
    pairs = _audited(spark, sf_dir)
    found = diff.hunks(pairs, "doc_id")
    return diff.apply_hunks(pairs.withColumnRenamed("before", "content"), found, found.where("doc_id % 3 <> 0")).select("path", "content", "applied")


def audit_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the code of each file that was not kept changes first."""
    found = review.preservation_audit(_audited(spark, sf_dir), places=True)
    # Taken out of a list: a condition on what was judged would be pushed down, and everything judged twice.
    places = found.select("path", F.inline(F.array_compact(F.array("change"))))
    return places.select("path", "code_line", F.col("before").alias("line_before"), F.col("after").alias("line_after"))


# Jobs and summaries


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = summary.run_summary(document_corpus(spark, sf_dir))
    return done.withColumn("messages", F.array_join("messages", "\n"))


def strip_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strip_corpus(_files(spark, sf_dir))


def strip_results_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every eleventh file could not be read."""
    unread = F.col("doc_id") % 11 == 0
    files = _files(spark, sf_dir).withColumn("read_error", F.when(unread, "gone"))
    return strip_results(files.withColumn("content", F.when(~unread, F.col("content"))), scope="strip_file")


def publish_approved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted outputs of the files that were approved, written and read back."""
    target = work_dir(spark, "published")
    approvals = _planned(spark, sf_dir).where("doc_id % 2 = 0").select("path")
    document.publish(document_corpus(spark, sf_dir), approvals, target)
    return spark.read.parquet(target).select("path", F.col("language").cast("string"), "content")


def strip_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``strip_files`` over files that arrive on a stream."""
    landing, target = work_dir(spark, "landing"), work_dir(spark, "stripped")
    _files(spark, sf_dir).select("path", "content").write.parquet(landing)
    strip_arriving(spark, landing, target, work_dir(spark, "progress")).awaitTermination()
    done = spark.read.parquet(target)
    return done.select("path", F.col("language").cast("string"), "content", "changed")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q
    for q in (
        detect_languages, decode_bytes, skip_folders, scan_select, scan_ordered, scan_ordered_top,
        language_scopes, not_blank_files, plan_summary, scan_tree, scan_source_tree, write_tree, commit_tree, write_table,
        strip_comments_regex, strip_comments_lexical, strip_docstrings, pages_strip_html,
        blank_lines, trim_text, strip_fences,
        file_lines, declarations, find_break_points, chunk_files, chunk_within_limit, chunk_rejoin,
        build_requests, request_envelopes, resolve_models, normalise_outputs, file_results,
        generate_batch, ask_once, document_corpus, document_corpus_edges, review_corpus, document_arriving, document_run,
        apply_spans, apply_spans_sparse, selection_extract, selection_replace, selection_requests, document_selections,
        length_guard, review_changes, review_stripped, review_hunks, approve_hunks, preservation_audit, audit_places,
        run_summary, strip_files, strip_results_of_files, publish_approved, strip_stream,
    )
}
