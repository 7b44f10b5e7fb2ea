"""One object for the tables of some DEX files, and for what is asked of them.

    program = Program.open(spark, "a.dex", "b.dex")
    program.findings(only_package="com.app").show()

Every answer is a lazy DataFrame over all methods at once. Tables that several answers share are written once to the shared
folder.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from bytelens.functions.java import class_path, excluded, in_package
from bytelens.operators import cfg, dataflow, detectors, emulator, passes, statements
from bytelens.runtime import materialize
from bytelens.sources import bytecode, dex, dex_format, payloads


class Program:
    def __init__(self, files: DataFrame):
        """files: dex_id, dex_ord, path, content, error, as dex.files and dex.checked give them."""
        self.spark, self.files = files.sparkSession, files

    @classmethod
    def open(cls, spark: SparkSession, *paths: str) -> Program:
        return cls(dex.files(spark, *paths))

    # -- catalog

    def errors(self) -> DataFrame:
        return dex.errors(self.files)

    def strings(self) -> DataFrame:
        return dex.strings(self.files)

    def class_names(self, only_package: str | None = None, exclude: list[str] | None = None) -> DataFrame:
        return dex.class_list(self.files, only_package, exclude)

    def enums(self) -> DataFrame:
        return dex.enums(self.files)

    def annotations(self) -> DataFrame:
        return dex.annotations(self.files)

    def find_method(self, class_name: str, method: str) -> DataFrame:
        return dex.find_methods(self.files, class_name, method)

    @cached_property
    def code(self) -> DataFrame:
        names = dex.methods(self.files).select("dex_id", "method_idx", F.col("class").alias("class_name"), F.col("name").alias("method_name"), "params", "return_type")
        return materialize(dex.code(self.files).join(names, ["dex_id", "method_idx"], "left"), "code")

    def _wanted(self, only_package: str | None, exclude: list[str] | None, class_name: str | None = None, method: str | None = None) -> DataFrame:
        t = self.code.select("method_uid", "class_name", "method_name")
        if only_package:
            t = t.where(in_package(F.col("class_name"), only_package))
        if exclude:
            t = t.where(~excluded(F.col("class_name"), exclude))
        if class_name:
            t = t.where(F.col("class_name") == class_name)
        return t.where(F.col("method_name") == method) if method else t

    # -- code

    @cached_property
    def instructions(self) -> DataFrame:
        """method_uid, off, mnemonic, operands (resolved, branches absolute), code_end."""
        ins = dex.resolve(bytecode.instructions(self.code), self.files, self.code)
        return materialize(bytecode.absolute_branches(ins), "instructions")

    def listing(self) -> DataFrame:
        return bytecode.raw_listing(self.code)

    @cached_property
    def cases(self) -> DataFrame:
        return materialize(bytecode.switch_cases(self.code, bytecode.instructions(self.code)), "cases")

    def tries(self) -> DataFrame:
        return dex.tries(self.files, self.code)

    @cached_property
    def blocks(self) -> DataFrame:
        return materialize(cfg.blocks(self.instructions.where("not mnemonic like '%-payload'"), self.cases), "blocks")

    @cached_property
    def placed(self) -> DataFrame:
        """method_uid, off, block_id of every instruction."""
        ins = self.instructions.where("not mnemonic like '%-payload'")
        return materialize(dataflow.membership(ins.select("method_uid", "off"), self.blocks), "placed")

    @cached_property
    def edges(self) -> DataFrame:
        return materialize(cfg.edges(self.blocks, self.cases), "edges")

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """Rows of nodes (method_uid, id, start, end, label) and of edges (method_uid, from, to), as drawn."""
        label = F.concat(F.lit("block "), "block_id", F.lit(": "), "end_kind")
        nodes = self.blocks.select("method_uid", F.col("block_id").alias("id"), F.col("start_off").alias("start"), F.col("end_off").alias("end"), label.alias("label"))
        return nodes, self.edges.select("method_uid", F.col("from_id").alias("from"), F.col("to_id").alias("to"))

    def statements(self) -> DataFrame:
        """method_uid, off, line: Java statements of straight code: calls joined with their results, constructors merged."""
        ir = statements.merge_constructors(statements.chain_calls(statements.intermediate(self.instructions)))
        return statements.lines(ir)

    @cached_property
    def passed(self) -> DataFrame:
        """The default pipeline's statements, block by block."""
        ins = cfg.placed(self.instructions.where("not mnemonic like '%-payload'"))
        return materialize(self.runner().run(statements.intermediate(ins)), "passed")

    def runner(self) -> passes.Runner:
        """The passes that `passed` runs; override it, or add to what it gives."""
        return passes.default_runner()

    @cached_property
    def variable_types(self) -> DataFrame:
        """method_uid, block_id, v, type: from the signatures of methods and of what they call."""
        m = dex.methods(self.files)
        counts = F.explode(F.array(F.size("params"), F.size("params") + 1))  # a call's registers begin with the receiver, if there is one
        signatures = m.where("return_type != 'void'").select(F.concat("class", F.lit("."), "name").alias("target"), counts.alias("n_args"), "return_type")
        given = passes.parameter_seeds(self.code).join(self.passed.select(*passes.BLOCK).distinct(), "method_uid").select(*passes.BLOCK, "v", "type")
        returned = passes.return_seeds(self.passed, self.code).join(given, [*passes.BLOCK, "v"], "left_anti")
        return passes.typed(self.passed, given.union(returned), signatures)

    @cached_property
    def variable_names(self) -> DataFrame:
        """method_uid, block_id, v, name."""
        return materialize(passes.names(self.passed, self.variable_types, self.code), "names")

    def source(self) -> DataFrame:
        """method_uid, block_id, off, line: the pipeline's statements with names in place of registers, and the literals of array data and switches."""
        lines = statements.lines(passes.renamed(self.passed, self.variable_names), shorten=False)
        said = payloads.literals(self.code, bytecode.instructions(self.code)).select("method_uid", "off", F.col("line").alias("literal"))
        return lines.join(said, ["method_uid", "off"], "left").select("method_uid", "block_id", "off", F.coalesce("literal", "line").alias("line"))

    def conditions(self) -> DataFrame:
        """method_uid, block_id, off, cond: conditions of branches, constants folded in and registers named."""
        placed = cfg.placed(self.instructions.where("not mnemonic like '%-payload'"))
        at = placed.select(*passes.BLOCK, "off").join(statements.folded_conditions(placed), ["method_uid", "off"]).select(*passes.BLOCK, "off", "cond")
        return passes.renamed_conditions(at, self.variable_names, self.code)

    # -- value flow

    @cached_property
    def rw(self) -> DataFrame:
        return materialize(dataflow.rw_sets(self.instructions), "rw")

    @cached_property
    def use_def(self) -> DataFrame:
        """Over all paths."""
        return materialize(dataflow.reaching_use_def(self.rw, self.blocks, self.edges), "use-def")

    def flow_from(self, seeds: DataFrame) -> DataFrame:
        """Reads and writes that seeds (method_uid, off, reg) taint."""
        tainted = dataflow.closure(seeds, dataflow.flow_edges(self.rw, self.use_def))
        return tainted.withColumn("is_write", F.lit(True)).union(dataflow.tainted_reads(tainted, self.use_def).withColumn("is_write", F.lit(False)))

    def flow_from_apis(self, patterns: list[str]) -> DataFrame:
        sources = dataflow.api_sources(self.instructions)
        hit = F.exists(F.array(*map(F.lit, patterns)), lambda p: F.contains(F.col("method_ref"), p))
        return self.flow_from(sources.where(hit).select("method_uid", "off", "reg"))

    # -- reports

    def findings(self, only_package: str | None = None, exclude: list[str] | None = None, taint_api: list[str] | None = None, categories: list[str] | None = None) -> DataFrame:
        table = detectors.with_sources("insecure_logging", taint_api) if taint_api else None
        found = detectors.find(self.spark, self.rw, self.use_def, dataflow.api_sources(self.instructions), dataflow.invoke_map(self.instructions), table, categories)
        return found.join(self._wanted(only_package, exclude), "method_uid")

    def pending_intents(self, only_package: str | None = None, exclude: list[str] | None = None) -> DataFrame:
        found = detectors.pending_intents(self.rw, self.use_def, dataflow.api_sources(self.instructions), dataflow.invoke_map(self.instructions), self.placed)
        return detectors.risk_label(found).join(self._wanted(only_package, exclude), "method_uid")

    def emulate(self, class_name: str, method: str, params: list[str] = (), max_steps: int = 10_000) -> DataFrame:
        """The trace of a method run with parameters given as text."""
        from bytelens.functions import stubs

        given = F.array(*[F.lit(p) for p in params]) if params else F.array().cast("array<string>")
        parsed = F.transform(given, stubs.parameter)
        values = F.transform(parsed, lambda p: F.struct(p["tag"].alias("tag"), F.when(p["tag"] == "Int", p["number"]).cast("int").alias("i"), p["text"].alias("s")))
        one = self.find_method(class_name, method).select(F.xxhash64("dex_id", "method_idx").alias("method_uid"))
        machines = self.code.join(one, "method_uid", "left_semi").select("method_uid", F.col("registers_size").cast("int").alias("registers_size"), values.alias("params"))
        return emulator.run(self.instructions.join(one, "method_uid", "left_semi"), machines, max_steps=max_steps)

    def files_of_source(self, only_package: str | None = None, exclude: list[str] | None = None) -> DataFrame:
        """path (of a class, as com/app/Main.java), text: the lines of each class's file in their order: a method's head, then its statements."""
        wanted = self._wanted(only_package, exclude).join(self.code.select("method_uid", "params", "return_type"), "method_uid")
        path = class_path(F.col("class_name"))
        head = F.concat(F.col("return_type"), F.lit(" "), F.col("method_name"), F.lit("("), F.array_join("params", ", "), F.lit("):"))
        heads = wanted.select(path.alias("path"), "method_name", "method_uid", F.lit(-1).cast("long").alias("off"), head.alias("text"))
        body = self.source().where("line != ''").join(wanted.select("method_uid", "method_name", path.alias("path")), "method_uid")
        t = heads.union(body.select("path", "method_name", "method_uid", "off", F.concat(F.lit("    "), "line")))
        order = ["path", "method_name", "method_uid", "off"]
        return t.repartition("path").sortWithinPartitions(*order).select("path", "text")

    def write_sources(self, folder: str, only_package: str | None = None, exclude: list[str] | None = None) -> None:
        """A text file for each class at its path below folder; none is visible before all are written."""
        dex_format.register(self.spark)
        self.files_of_source(only_package, exclude).write.format("tree").mode("append").save(folder)

    def text(self, class_name: str) -> str:
        """One class as text: what its file would hold."""
        simple = self.files_of_source(class_name).where(F.col("path") == class_path(F.lit(class_name)))
        return "".join(r.text + "\n" for r in simple.collect())  # one class, in one task's order
