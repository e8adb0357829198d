"""Command line: ``python -m glotspark COMMAND ...``, each with a report on the standard output and an exit code (1 on findings)."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import audit as A
from .operators import corpus, graph, lexicon, nlu, quality, stats, strategy
from .sources import readers, sinks, synthetic


def _show(a: argparse.Namespace, df: DataFrame, title: str) -> str:
    return sinks.report_json(df) if a.format == "json" else sinks.markdown(df, title)


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a CSV with ``row``: ascending from 1 in the order of files and lines."""
    rows, _ = readers.read_csv(spark, path)
    # Partitions are numbered in order; a row's number is its place within, and what the partitions before hold.
    marked = rows.withColumn("__id", F.monotonically_increasing_id())
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted(marked.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # a row for each partition
    before, total = {}, 0
    for r in counts:
        before[r.p], total = total, total + r.n
    starts = F.create_map(*(F.lit(x) for kv in before.items() for x in kv)) if before else F.lit(None)
    return marked.withColumn("row", (starts[part] + place + 1).cast("long") if before else F.lit(None).cast("long")).drop("__id")


def audit(a: argparse.Namespace, spark: SparkSession) -> tuple[str, int]:
    head, found = quality.audit(_numbered(spark, a.path), "row", a.key_col, a.base)
    out = sinks.audit_report(head, found, "json" if a.format == "json" else "md", a.max_findings)
    if a.format == "both":
        out += "\n" + sinks.audit_report(head, found, "json", a.max_findings)
    return out, int(bool(head["counts"]))


def adherence(a: argparse.Namespace, spark: SparkSession) -> tuple[str, int]:
    glossary, segments = (_numbered(spark, p) for p in (a.glossary, a.segments))
    langs = A.languages(glossary.drop("row"), segments)
    term, source = ("term" if "term" in glossary.columns else "source"), "source"
    pairs = corpus.long_form(glossary.select(F.col(term).alias("term"), *langs), "term", langs).toDF("term", "lang", "expected")
    texts = corpus.long_form(segments.select(F.col("row").alias("id"), F.col(source).alias("source"), *langs), ["id", "source"], langs).toDF("id", "source", "lang", "target")
    rates, misses = A.adherence(texts, pairs, a.case_sensitive)
    out = _show(a, rates.orderBy("rate", "lang"), "Glossary adherence") + "\n" + _show(a, misses.orderBy("id", "lang", "term").limit(a.max_misses), "Misses")
    return out, sinks.gate(rates, sinks.GATES["adherence"])


def ab(a: argparse.Namespace, spark: SparkSession) -> tuple[str, int]:
    chosen = strategy.strategies(a.min_len)
    held = strategy.predictions(_numbered(spark, a.gold).select(F.col("row").alias("id"), "text", "term", "gold"), chosen)
    out = _show(a, strategy.confusion(held, list(chosen)).orderBy(F.desc("f1"), "strategy"), "Strategies")
    if a.significance:
        out += "\n" + json.dumps(strategy.significance(held, list(chosen), a.n_boot, seed=a.seed), indent=2)
    return out, 0


def _lexicon(a: argparse.Namespace, spark: SparkSession) -> tuple[str, int]:
    rows = _numbered(spark, a.glossary).drop("row")
    langs = [c for c in rows.columns if quality.is_language(c) and c not in ("domain", "pos", "synonyms", "broader")]
    for c in ("id", "broader", "domain", "pos", "synonyms"):
        rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast("string"))
    concepts, warned = lexicon.built(rows, langs)
    if a.lookup:
        return lexicon.card(concepts, langs, a.lookup), 0
    if a.ancestors:
        return _show(a, graph.ancestors(concepts).where(F.col("id") == a.ancestors).orderBy("depth").select("ancestor", "depth"), f"Above {a.ancestors}"), 0
    if a.descendants:
        return _show(a, lexicon.descendants(concepts, a.descendants).orderBy("depth", "id"), f"Under {a.descendants}"), 0
    if a.topo:
        return "\n".join(lexicon.ordered(concepts)) + "\n", 0
    if a.link:
        text = spark.createDataFrame([(0, a.link)], "id long, text string")
        return _show(a, lexicon.link(text, lexicon.surfaces(concepts, langs)).select("concept", "surface").orderBy("concept"), "Concepts"), 0
    if a.format == "triples":
        return "".join(f"{r.s} {r.p} {r.o} .\n" for r in lexicon.triples(concepts, langs).orderBy("s", "p", "o").toLocalIterator()), 0
    if a.format == "json":
        return "\n".join(r.json for r in lexicon.export(concepts, langs).orderBy("kind", "json").toLocalIterator()) + "\n", 0
    return sinks.markdown(lexicon.stats(concepts, langs), "Lexicon") + "\n" + sinks.markdown(warned, "Warnings"), 0


def bias(a: argparse.Namespace, spark: SparkSession) -> tuple[str, int]:
    rows = _numbered(spark, a.path)
    langs = quality.columns_of(rows.drop("row"))[1]
    if not langs:
        raise SystemExit("no language columns")
    base = a.base if a.base in langs else quality.most_filled(rows, langs)
    found = quality.equity(quality.states(rows, "row", langs, base, a.short_ratio))
    return _show(a, found.orderBy("coverage", "lang"), "Language equity") + "\n" + _show(a, quality.spread(found), "Spread"), sinks.gate(found, sinks.GATES["equity"])


def merge(a: argparse.Namespace, spark: SparkSession) -> tuple[str, int]:
    cells = None
    for k, path in enumerate(a.sources):
        rows = _numbered(spark, path)
        named = [c for c in rows.columns if c != "row"]
        key = a.key if a.key in named else named[0]
        langs = [c for c in named if c != key]
        one = corpus.long_form(rows.select("row", X.strip(F.col(f"`{key}`")).alias("key"), *langs), ["row", "key"], langs)
        one = one.select(F.lit(k).alias("source"), F.col("row").alias("row_no"), "key", X.canon_lang(F.col("lang")).alias("lang"), "value").where("key <> ''")
        cells = one if cells is None else cells.union(one)
    merged, conflicts = corpus.merge_sources(cells)
    merged = corpus.fold_base(merged) if a.merge_base else merged
    if a.out:
        langs = sorted(r.lang for r in merged.select("lang").distinct().collect())
        sinks.write_csv(sinks.wide(merged, "key", langs), a.out)
    return _show(a, corpus.provenance(merged).orderBy("source"), "Cells of each source") + "\n" + _show(a, conflicts.orderBy("key", "lang").limit(40), "Conflicts"), sinks.gate(conflicts, sinks.GATES["merge"])


def cluster(a: argparse.Namespace, spark: SparkSession) -> tuple[str, int]:
    found = graph.clusters(_numbered(spark, a.path), a.id_col, a.signal_cols.split(","), folded=True)
    sizes = found.groupBy("cluster").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(a.id_col)), ", ").alias("members")).where("n > 1")
    return _show(a, sizes.orderBy(F.desc("n"), "cluster"), "Clusters"), sinks.gate(sizes, sinks.GATES["cluster"])


def top_k(a: argparse.Namespace, spark: SparkSession) -> tuple[str, int]:
    rows = _numbered(spark, a.path)
    langs = quality.columns_of(rows.drop("row"))[1]
    base = a.base if a.base in langs else quality.most_filled(rows, langs)
    return _show(a, corpus.top_k(quality.untranslated_counts(rows, "row", langs, base), "term", "n", a.k), "Untranslated terms"), 0


def intents(a: argparse.Namespace, spark: SparkSession) -> tuple[str, int]:
    made = stats.fill_templates(*nlu.read_spec(spark, a.spec), a.max_per_template, a.seed)
    if a.out:
        sinks.jsonl(made, a.out)
    if a.stats or a.out:
        return _show(a, nlu.balance(made).orderBy("level", "lang", "intent"), "Balance"), 0
    return "".join(r.j + "\n" for r in made.select(F.to_json(F.struct(*made.columns)).alias("j")).toLocalIterator()), 0


def noise(a: argparse.Namespace, spark: SparkSession) -> tuple[str, int]:
    found = stats.noise_sweep(synthetic.intents(spark, a.n, a.seed), [float(x) for x in a.rates.split(",")], a.seed)
    return _show(a, found.orderBy("rate"), "Label noise"), 0


def coverage(a: argparse.Namespace, spark: SparkSession) -> tuple[str, int]:
    rows, _ = readers.read_csv(spark, a.path)
    key, *langs = rows.columns
    found = corpus.equity(corpus.coverage(corpus.long_form(rows, key, langs)))
    return _show(a, found.orderBy("lang"), "Coverage"), sinks.gate(found, sinks.GATES["equity"])


def inspect(a: argparse.Namespace, spark: SparkSession) -> tuple[str, int]:
    found = readers.inspect(spark, a.path)
    return _show(a, found, "Encodings"), sinks.gate(found, "verdict = 'unknown'")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="glotspark", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name, run, *arguments, formats=("md", "json")):
        c = sub.add_parser(name)
        for names, options in arguments:
            c.add_argument(*names, **options)
        if formats:
            c.add_argument("--format", choices=formats, default=formats[0])
        c.set_defaults(run=run)

    arg = lambda *names, **options: (names, options)
    path, base = arg("path"), arg("--base", help="the source language's column (default: the one most filled)")
    out, seed = arg("--out"), arg("--seed", type=int, default=0)
    command("audit", audit, path, arg("--key-col"), base, out, arg("--max-findings", type=int, default=50), formats=("md", "json", "both"))
    command("adherence", adherence, arg("--glossary", required=True), arg("--segments", required=True), arg("--case-sensitive", action="store_true"), out, arg("--max-misses", type=int, default=50))
    command("ab", ab, arg("gold"), arg("--min-len", type=int, default=3), arg("--significance", action="store_true"), arg("--n-boot", type=int, default=2000), seed)
    command("lexicon", _lexicon, arg("glossary"), arg("--lookup"), arg("--ancestors"), arg("--descendants"), arg("--topo", action="store_true"), arg("--link"), out, formats=("stats", "json", "triples"))
    command("bias", bias, path, base, arg("--short-ratio", type=float, default=0.3))
    command("merge", merge, arg("sources", nargs="+"), arg("--key"), arg("--merge-base", action="store_true"), arg("-o", "--out"))
    command("cluster", cluster, path, arg("--id-col", required=True), arg("--signal-cols", required=True))
    command("top-k", top_k, path, arg("--k", type=int, default=10), base)
    command("nlu", intents, arg("spec"), arg("--max-per-template", type=int, default=20), seed, out, arg("--stats", action="store_true"))
    command("noise", noise, arg("--n", type=int, default=1500), arg("--rates", default="0,0.4,0.45,0.5"), seed)
    command("coverage", coverage, path)
    command("inspect", inspect, path)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("glotspark").getOrCreate()
    out, code = a.run(a, spark)
    if getattr(a, "out", None) and a.command in ("audit", "adherence", "lexicon"):
        Path(a.out).write_text(out, encoding="utf-8")
    else:
        print(out)
    return code


if __name__ == "__main__":
    sys.exit(main())
