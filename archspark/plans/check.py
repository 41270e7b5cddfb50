"""The check: one plan from files to violations, contract errors and summaries.

files -> capsules, scopes -> imports (one Arrow pass) -> targets -> owners of both ends ->
edges that no contract allows. Sides of the size of the contracts are broadcast by Spark's
own size checks; owners are found for distinct (contract, path) pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..functions import paths, text
from ..languages import LANGUAGES, Language, resolve_languages
from ..languages import resolve as targets
from ..languages.recognise import SourceError
from ..operators import validate
from ..operators.match import match_nodes
from ..schema import CONTRACT_FILE, SOURCE
from ..sources import contracts as contract_files
from ..sources import discover, files as trees
from ..sources.shared import cut

_IMPORTS = "abs string, imports array<struct<path: string, line: int, col: int, col_end: int>>, error string"
VIOLATION = ["capsule_dir", "rule", "severity", "source", "message", "file", "line", "col", "col_end"]


def parse_imports(files: DataFrame) -> DataFrame:
    """(abs, lang, content) -> abs, imports, error; both null for a file that can't be read."""
    kind = _parse_datatype_string(_IMPORTS)
    arrow = to_arrow_schema(kind)
    parsers = {x.name: x.parse for x in LANGUAGES.values()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, lang, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = {"abs": path, "imports": None, "error": None}
                if content is not None:
                    try:
                        row["imports"] = [dict(zip(("path", "line", "col", "col_end"), i, strict=True)) for i in parsers[lang](content)]
                    except SourceError as e:
                        row["error"] = f"{path}:{e}"
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return files.select("abs", "lang", "content").mapInArrow(run, kind)


def _aliases(caps: DataFrame, files: DataFrame) -> DataFrame:
    """capsule_dir, pattern, replacements, base_url from each TypeScript capsule's configuration and those it extends."""
    shape = "struct<compilerOptions: struct<baseUrl: string, paths: map<string, array<string>>>, extends: string>"
    configs = files.filter(~F.col("is_dir") & F.endswith(F.col("abs"), F.lit(".json"))).select(F.col("abs").alias("config"), F.from_json(F.col("content").cast("string"), shape, {"mode": "PERMISSIVE"}).alias("c")).filter("c is not null")
    own = caps.filter("lang = 'typescript'").select("capsule_dir", F.col("capsule_dir").alias("at"), F.concat("capsule_dir", F.lit("/tsconfig.json")).alias("config"), F.lit(0).alias("depth"))
    every, step = None, own
    while every is None or not step.isEmpty():  # configurations that extend others, nearest first
        read = cut(step.join(configs, "config"))
        every = read if every is None else every.unionByName(read)
        e = F.col("c.extends")
        target = F.when(F.startswith(e, F.lit("/")), e).otherwise(F.concat("at", F.lit("/node_modules/"), e, F.lit("/tsconfig.json")))
        step = read.filter("c.extends <> ''").select("capsule_dir", paths.clean(target).alias("config"), (F.col("depth") + 1).alias("depth")).withColumn("at", paths.dirname("config"))
        step = step.join(every.select("capsule_dir", "config"), ["capsule_dir", "config"], "left_anti")  # a ring ends here
    base = every.filter("c.compilerOptions.baseUrl <> ''").groupBy("capsule_dir").agg(F.min_by(F.regexp_replace("c.compilerOptions.baseUrl", "/$", ""), "depth").alias("base_url"))
    pairs = every.select("capsule_dir", "depth", F.explode("c.compilerOptions.paths").alias("pattern", "replacements")).groupBy("capsule_dir", "pattern").agg(F.min_by("replacements", "depth").alias("replacements"))
    return pairs.filter(F.size("replacements") > 0).join(base, "capsule_dir", "left")


def resolved(imports: DataFrame, caps: DataFrame, files: DataFrame, hidden: DataFrame) -> DataFrame:
    """imports (capsule_dir, capsule_id, lang, abs, rel, scope, path, ...) that lead to a visible place of their capsule, with target and target_abs."""
    spec, rel, capsule_id = F.col("path"), F.col("rel"), F.col("capsule_id")
    plain = F.when(F.col("lang") == "go", targets.go(spec, capsule_id)).when(F.col("lang") == "dart", targets.dart(spec, capsule_id, rel)).when(F.col("lang") == "kotlin", targets.kotlin(spec, capsule_id, rel)).when(F.col("lang") == "rust", targets.rust(spec, capsule_id, rel))
    out = imports.filter("lang <> 'typescript'").withColumn("target", plain)
    spoken = {r.lang for r in caps.select("lang").distinct().collect()}  # as many as there are languages
    if "typescript" not in spoken:
        every = out.filter("target is not null").withColumn("target_abs", paths.join(F.col("capsule_dir"), F.col("target")))
        return every.join(hidden.select(F.col("abs").alias("target_abs")), "target_abs", "left_anti")
    ts = imports.filter("lang = 'typescript'")
    existing = files.select("abs")
    bare = ts.filter(~F.startswith(spec, F.lit("."))).select("capsule_dir", spec.alias("spec"))
    found = targets.typescript_aliases(bare, _aliases(caps, files), existing).select("capsule_dir", F.col("spec").alias("path"), F.col("target").alias("alias"))
    near = paths.let(paths.join(paths.dirname(rel), spec), lambda p: F.when(~paths.escapes(p), p))
    ts = ts.join(found, ["capsule_dir", "path"], "left").withColumn("target", F.when(F.startswith(spec, F.lit(".")), near).otherwise(F.coalesce("alias", targets.typescript_name(spec, capsule_id)))).drop("alias").filter("target is not null")
    ts = ts.join(targets.typescript_endings(ts, existing), ["capsule_dir", "target"]).withColumn("target", F.col("file")).drop("file")
    every = out.unionByName(ts).filter("target is not null").withColumn("target_abs", paths.join(F.col("capsule_dir"), F.col("target")))
    return every.join(hidden.select(F.col("abs").alias("target_abs")), "target_abs", "left_anti")


@dataclass
class Check:
    """Frames: capsules (a row for each that has a contract), violations, errors, files, relations."""

    capsules: DataFrame
    violations: DataFrame
    errors: DataFrame
    tracked: DataFrame
    relations: DataFrame
    contracts: DataFrame


def _violation(rows: DataFrame, rule: str, message: Column, placed: bool = True) -> DataFrame:
    at = {c: F.col(c) if placed else F.lit(None).cast("int") for c in ("line", "col", "col_end")}
    return rows.select("capsule_dir", F.lit(rule).alias("rule"), F.lit("error").alias("severity"), F.lit(SOURCE).alias("source"), message.alias("message"), F.col("abs").alias("file"), *[c.alias(n) for n, c in at.items()])


def verdicts(relations: DataFrame, nodes: DataFrame, edges: DataFrame, contracts: DataFrame, roots: DataFrame) -> DataFrame:
    """Relations with what they break: rule (null: allowed), message.

    relations: capsule_dir, abs, rel, scope, contract, src, path, line, col, col_end, target,
    target_abs, target_scope; src is the owner of the file in its scope's contract.

    Within a scope its contract decides. Across scopes the first that can does: the file's
    own, if it owns the target; then contracts above, if they own both ends; then the
    capsule's root contract. What none decides is allowed.
    """
    same = F.col("scope") == F.col("target_scope")
    key = ["capsule_dir", "abs", "path", "line", "col"]
    within = relations.select("*", paths.relative("scope", "target_abs").alias("target_rel"))
    # Candidates: (rank, contract, directory its paths are relative to).
    own = within.select(*key, "target_abs", F.lit(0).alias("rank"), "contract", F.col("scope").alias("at")).filter(~paths.escapes(paths.relative("at", "target_abs")))
    crossing = relations.filter(~same)
    chain = crossing.select(*key, "scope", "target_abs", F.posexplode(paths.ancestors("scope")).alias("up", "at")).filter((F.col("at") == F.col("capsule_dir")) | F.startswith(F.col("at"), F.concat("capsule_dir", F.lit("/"))))
    above = chain.join(contracts.select(F.col("dir").alias("at"), "contract", "readable"), "at")
    # A contract that can't be read ends the way up.
    order = Window.partitionBy(*key).orderBy("up").rowsBetween(Window.unboundedPreceding, 0)
    above = above.withColumn("clear", F.min(F.col("readable").cast("int")).over(order)).filter("clear = 1").select(*key, "target_abs", (F.col("up") + 1).alias("rank"), "contract", "at")
    root = crossing.select(*key, "target_abs").join(roots.filter("readable").select("capsule_dir", "contract"), "capsule_dir").select(*key, "target_abs", F.lit(1 << 20).alias("rank"), "contract", F.col("capsule_dir").alias("at"))
    tries = own.unionByName(above).unionByName(root)
    tries = cut(tries.withColumn("src_path", paths.relative("at", "abs")).withColumn("dst_path", paths.relative("at", "target_abs")))
    wanted = tries.select("contract", F.col("src_path").alias("path")).union(tries.select("contract", "dst_path")).distinct()
    owners = cut(match_nodes(wanted, nodes).filter("node_id is not null"))
    side = lambda x: owners.select("contract", F.col("path").alias(f"{x}_path"), F.col("node_id").alias(x))
    decided = tries.join(side("src"), ["contract", "src_path"]).join(side("dst"), ["contract", "dst_path"])
    best = decided.groupBy(*key).agg(F.min_by(F.struct("rank", F.col("contract").alias("by"), "src", "dst", "dst_path"), "rank").alias("d"))
    out = within.drop("src").join(best, key, "left")
    out = out.join(edges.select(F.col("contract").alias("e_by"), F.col("src").alias("e_src"), F.col("dst").alias("e_dst")).distinct(), (F.col("d.by") == F.col("e_by")) & (F.col("d.src") == F.col("e_src")) & (F.col("d.dst") == F.col("e_dst")), "left")
    shy = nodes.filter(F.array_contains("classes", "endophobic")).select(F.col("contract").alias("s_by"), F.col("node_id").alias("s_node")).distinct()
    out = out.join(shy, (F.col("d.by") == F.col("s_by")) & (F.col("d.src") == F.col("s_node")), "left")
    rule = (
        F.when(same & F.col("d").isNull(), "import-no-node")
        .when(F.col("d").isNull(), None)
        .when(F.col("d.src") == F.col("d.dst"), F.when(same & F.col("s_node").isNotNull(), "endophobic"))
        .when(F.col("e_by").isNull(), "import-not-allowed")
    )
    scope_rel = paths.relative("scope", "abs")
    # Across scopes paths are the capsule's; above the file's own contract the target's, too.
    shown = F.when(same, scope_rel).otherwise(F.col("rel"))
    target = F.when(F.col("d.rank") == 0, F.col("d.dst_path")).otherwise(F.when(F.col("d.rank") < 1 << 20, F.col("target")).otherwise(F.col("d.dst_path")))
    message = (
        F.when(rule == "import-no-node", text.import_no_node_message(scope_rel, F.col("line"), F.col("col"), F.col("path"), F.col("contract")))
        .when(rule == "endophobic", text.endophobic_message(scope_rel, F.col("line"), F.col("col"), F.col("d.src"), F.col("d.dst_path"), F.col("d.by")))
        .when(rule == "import-not-allowed", text.relation_message(shown, F.col("line"), F.col("col"), F.col("d.src"), target, F.col("d.dst"), F.col("d.by")))
    )
    return out.withColumn("rule", rule).withColumn("message", message)


def check(files: DataFrame, root: str, languages: list[Language] | None = None, contract_name: str = CONTRACT_FILE, ignore_names: tuple[str, ...] = trees.IGNORE_FILES, within: Iterable[str] | None = None) -> Check:
    """files: abs, is_dir, content of a whole tree, before ignore rules; with `within` only files of capsules in these directories are looked into."""
    languages = languages or resolve_languages()
    seen = cut(trees.visible(files, root, ignore_names))
    caps = cut(discover.capsules(seen, root, languages))
    found = discover.contract_dirs(seen, contract_name)
    parsed = cut(contract_files.read(found))
    nodes, edges = contract_files.nodes_of(parsed), contract_files.edges_of(parsed)
    contracts = found.select("contract", "dir").join(parsed.select("contract", F.col("error").isNull().alias("readable"), "error", "error_line"), "contract")
    roots = discover.root_contract(caps, found, root, contract_name).join(contracts.select("contract", "readable"), "contract", "left")
    has_root = F.col("readable").isNotNull()
    # A capsule without any contract, or whose root contract can't be read, is not looked into.
    inside = caps.select("capsule_dir").join(found.select("dir"), (F.col("dir") == F.col("capsule_dir")) | F.startswith(F.col("dir"), F.concat("capsule_dir", F.lit("/")))).filter("dir <> capsule_dir").select("capsule_dir").distinct().withColumn("scoped", F.lit(True))
    state = roots.join(inside, "capsule_dir", "left").filter(has_root | F.col("scoped"))
    open_caps = caps.join(state.filter(~has_root | F.col("readable")).select("capsule_dir"), "capsule_dir", "left_semi")
    if within is not None:
        places = files.sparkSession.createDataFrame([(d,) for d in within], "up string")
        chain = open_caps.select("capsule_dir", F.explode(F.concat(F.array("capsule_dir"), paths.ancestors("capsule_dir"))).alias("up"))
        open_caps = open_caps.join(chain.join(places, "up", "left_semi").select("capsule_dir"), "capsule_dir", "left_semi")
    own = discover.tracked(seen, caps, found, root).join(open_caps.select("capsule_dir"), "capsule_dir", "left_semi")
    # The contract of each file's scope: the root contract at the capsule itself.
    by_scope = contracts.filter("readable").select(F.col("dir").alias("scope"), F.col("contract").alias("scoped_contract"))
    own = own.join(by_scope, "scope", "left").join(roots.filter("readable").select("capsule_dir", F.col("contract").alias("root_contract")), "capsule_dir", "left")
    own = own.withColumn("contract", F.when(F.col("scope") == F.col("capsule_dir"), F.col("root_contract")).otherwise(F.col("scoped_contract")))
    own = own.drop("scoped_contract", "root_contract").withColumn("scope_rel", paths.relative("scope", "abs"))
    looked = own.filter("contract is not null")
    imports = parse_imports(looked)
    owners = match_nodes(looked.select("contract", F.col("scope_rel").alias("path")), nodes).select("contract", F.col("path").alias("scope_rel"), F.col("node_id").alias("src"))
    tracked = cut(looked.drop("content").join(owners, ["contract", "scope_rel"]).join(imports, "abs"))
    rows = tracked.select("*", F.explode("imports").alias("i")).select(*[c for c in tracked.columns if c not in ("imports", "error")], "i.*")
    internal = resolved(rows, caps, seen, trees.empty_dirs(files, seen))
    dirs = internal.select("capsule_dir", paths.dirname("target_abs").alias("dir")).distinct()
    placed = discover.scopes(dirs, found).withColumnRenamed("scope", "target_scope")
    internal = cut(internal.withColumn("dir", paths.dirname("target_abs")).join(placed, ["capsule_dir", "dir"]).drop("dir"))
    relations = internal.filter("src is not null")
    judged = cut(verdicts(relations, nodes, edges, contracts, roots))
    broken = judged.filter("rule is not null")
    violations = broken.select("capsule_dir", "rule", F.lit("error").alias("severity"), F.lit(SOURCE).alias("source"), "message", F.col("abs").alias("file"), "line", "col", "col_end")
    ownerless = tracked.filter("src is null")
    violations = violations.unionByName(_violation(ownerless, "no-node", text.no_node_message(F.col("scope_rel"), F.col("contract")), False))
    violations = violations.unionByName(_violation(internal.filter("src is null"), "import-no-node", text.import_no_node_message(F.col("scope_rel"), F.col("line"), F.col("col"), F.col("path"), F.col("contract"))))
    # Contracts that some file or search touched, with the language of the capsule.
    touched = own.select("capsule_dir", "lang", "contract").filter("contract is not null").union(roots.filter("readable").join(caps, "capsule_dir").select("capsule_dir", "lang", "contract")).distinct()
    with_globs = F.col("lang").isin(*[x.name for x in languages if x.file_globs])
    errors = contract_errors(seen, nodes, edges, touched.withColumn("file_globs", with_globs), contracts)
    failed = state.filter(has_root & ~F.col("readable")).select("capsule_dir", "contract")
    scoped_failed = own.filter("contract is null").select("capsule_dir", F.col("scope").alias("dir")).distinct().join(contracts.filter("not readable").select("dir", "contract"), "dir").select("capsule_dir", "contract")
    loads = failed.union(scoped_failed).distinct().join(contracts.select("contract", "error", "error_line"), "contract").select("capsule_dir", "contract", F.lit("contract-load-error").alias("rule"), F.col("error").alias("message"), F.col("error_line").alias("line"))
    errors = cut(errors.unionByName(loads))
    broken_files = tracked.filter("error is not null and src is not null").groupBy("capsule_dir").agg(F.min("error").alias("source_error"))
    summary = summarise(state, caps, tracked, internal, nodes, edges, errors, roots, broken_files)
    keep = summary.select("capsule_dir", F.expr("not void_all and not void_violations and source_error is null").alias("keep"))
    violations = violations.join(keep.filter("keep").select("capsule_dir"), "capsule_dir", "left_semi")
    return Check(summary, violations, distinct_errors(errors, summary), tracked, relations, parsed)


def contract_errors(seen: DataFrame, nodes: DataFrame, edges: DataFrame, touched: DataFrame, contracts: DataFrame) -> DataFrame:
    """capsule_dir, contract, rule, message, line."""
    from ..languages import scannable

    own = touched.join(contracts.select("contract", "dir"), "contract")
    used = nodes.join(own.select("contract").distinct(), "contract", "left_semi")
    edges = edges.join(own.select("contract").distinct(), "contract", "left_semi")
    places = seen.filter(~F.col("is_dir")).select("abs", F.explode(paths.ancestors("abs")).alias("dir"))
    witnesses = places.join(own.select("contract", "dir", "lang").distinct(), "dir").withColumn("rel", paths.relative("dir", "abs"))
    witnesses = discover.in_walk_order(witnesses.filter(scannable(F.col("rel"), F.col("lang")))).select("contract", "rel", "walk")
    found = validate.validate(used, edges, witnesses, own.select("contract", "file_globs").distinct())
    return own.select("capsule_dir", "contract").distinct().join(found, "contract").select("capsule_dir", "contract", "rule", "message", "line")


def summarise(state: DataFrame, caps: DataFrame, tracked: DataFrame, internal: DataFrame, nodes: DataFrame, edges: DataFrame, errors: DataFrame, roots: DataFrame, broken_files: DataFrame) -> DataFrame:
    """A row for each capsule with a contract. Overlapping or duplicate globs void counts and violations, invalid ones violations."""
    counts = tracked.groupBy("capsule_dir").agg(F.count(F.lit(1)).alias("files_encountered"), F.count(F.when(F.col("src").isNotNull() & F.col("imports").isNotNull(), 1)).alias("files_scanned"))
    related = internal.filter("src is not null").groupBy("capsule_dir").agg(F.count(F.lit(1)).alias("relations"))
    graph = roots.join(nodes.groupBy("contract").agg(F.count(F.lit(1)).alias("nodes")), "contract", "left").join(edges.groupBy("contract").agg(F.count_distinct("src", "dst").alias("edges")), "contract", "left").select("capsule_dir", "nodes", "edges")
    flags = errors.groupBy("capsule_dir").agg(F.bool_or(F.col("rule").isin("node-overlap", "duplicate-node-glob")).alias("void_all"), F.bool_or(F.col("rule") == "invalid-node-glob").alias("void_violations"))
    out = state.select("capsule_dir").join(caps, "capsule_dir")
    for frame in (counts, related, graph, flags, broken_files):
        out = out.join(frame, "capsule_dir", "left")
    void = F.coalesce("void_all", F.lit(False))
    number = lambda c: F.when(void | F.col("source_error").isNotNull(), 0).otherwise(F.coalesce(c, F.lit(0))).cast("int").alias(c)
    size = lambda c: F.when(F.col("source_error").isNotNull(), 0).otherwise(F.coalesce(c, F.lit(0))).cast("int").alias(c)
    return cut(out.select("capsule_dir", F.col("capsule_dir").alias("label"), "lang", *map(number, ("files_encountered", "files_scanned", "relations")), *map(size, ("nodes", "edges")), void.alias("void_all"), F.coalesce("void_violations", F.lit(False)).alias("void_violations"), "source_error"))


def distinct_errors(errors: DataFrame, summary: DataFrame) -> DataFrame:
    """Each error of a contract once, for the first capsule by label that has it."""
    rows = errors.distinct().join(summary.select("capsule_dir", "label"), "capsule_dir")
    first = Window.partitionBy("contract", "message").orderBy("label", "capsule_dir")
    return rows.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")
