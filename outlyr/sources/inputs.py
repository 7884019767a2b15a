"""Inputs: dataset folders, structure files as text, ligand files, earlier tables and checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

REVIEW = T.StructType([T.StructField("dtag", T.StringType()), T.StructField("event_idx", T.IntegerType()), T.StructField("Interesting", T.BooleanType()), T.StructField("Ligand Placed", T.BooleanType()), T.StructField("Ligand Confidence", T.StringType()), T.StructField("Comment", T.StringType()), T.StructField("Viewed", T.BooleanType())])
QUANTILES = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("p", T.DoubleType())])


def files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, dtag, name, length) of all files below ``root``; contents are read only if asked for."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
    rest = F.regexp_replace(F.substring_index("path", root.rstrip("/").split(":")[-1].lstrip("/"), -1), "^/+", "")
    return raw.select("path", F.substring_index(rest, "/", 1).alias("dtag"), F.element_at(F.split("path", "/"), -1).alias("name"), "length", "content")


def discover(found: DataFrame, model: str, reflections: str) -> DataFrame:
    """(dtag, model, reflections): the first path of each kind; folders without both are left out."""
    first = lambda pattern: F.min(F.when(F.col("name").rlike(f"^(?:{pattern})"), F.col("path")))
    both = found.groupBy("dtag").agg(first(model).alias("model"), first(reflections).alias("reflections"))
    return both.where("model is not null and reflections is not null")


def undone(inputs: DataFrame, done: DataFrame) -> DataFrame:
    """Datasets without a checkpoint yet."""
    return inputs.join(done.select("dtag").distinct(), "dtag", "left_anti")


def ligands(found: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(dtag, ligands): a map from file stem to its cif, smiles and pdb paths."""
    stem = F.regexp_extract("name", r"^(.*)\.(cif|smiles|pdb)$", 1)
    kind = F.regexp_extract("name", r"^(.*)\.(cif|smiles|pdb)$", 2)
    a = found.withColumn("stem", stem).withColumn("kind", kind).where((F.col("stem") != "") & ~F.col("stem").isin(list(ignore)))
    b = a.groupBy("dtag", "stem").agg(*[F.min(F.when(F.col("kind") == k, F.col("path"))).alias(k) for k in ("cif", "smiles", "pdb")])
    return b.groupBy("dtag").agg(F.map_from_entries(F.collect_list(F.struct("stem", F.struct("cif", "smiles", "pdb")))).alias("ligands"))


def merge_ligands(found: DataFrame) -> DataFrame:
    """(dtag, stem, cif, smiles, pdb) of several folders: later complete ones (cif and pdb) replace earlier."""
    complete = (F.col("cif").isNotNull() & F.col("pdb").isNotNull()).cast("int")
    row = F.struct("cif", "smiles", "pdb")
    return found.groupBy("dtag", "stem").agg(F.max_by(row, F.struct(complete, F.col("folder"))).alias("l")).select("dtag", "stem", "l.*")


def valid_text(name: str = "name", content: str = "content") -> Column:
    """Whether a file can be used: models hold two atoms, SMILES two characters, others anything."""
    text = F.decode(F.col(content), "UTF-8")
    atoms = F.regexp_count(text, F.lit(r"(?m)^(?:ATOM  |HETATM)"))
    return F.when(F.col(name).endswith(".pdb"), atoms > 1).when(F.col(name).endswith(".smiles"), F.length(F.trim(text)) > 1).otherwise(F.length(content) > 0)


def atoms(spark: SparkSession, path: str, dtag: str | None = None) -> DataFrame:
    """Atoms of PDB files by their fixed columns, first conformer, with the model's number."""
    lines = spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\n")).alias("n", "line"))
    w = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    model = F.coalesce(F.last(F.when(F.col("line").startswith("MODEL"), F.substring("line", 11, 4).cast("int")), ignorenulls=True).over(w), F.lit(1))
    a = lines.withColumn("model", model).where(F.substring("line", 1, 6).isin("ATOM  ", "HETATM"))
    # of a residue's places for one atom, the first letter's
    place = Window.partitionBy("path", "model", F.substring("line", 22, 6), F.substring("line", 13, 4)).orderBy(F.substring("line", 17, 1), "n")
    a = a.withColumn("_place", F.row_number().over(place)).where("_place = 1")
    part = lambda at, n: F.trim(F.substring("line", at, n))
    name = F.lit(dtag) if dtag else F.element_at(F.split("path", "/"), -2)
    return a.select(name.alias("dtag"), "model", part(22, 1).alias("chain"), part(23, 4).alias("seq_id"), part(27, 1).alias("icode"), part(13, 4).alias("atom_id"), part(18, 3).alias("residue_name"), *[part(31 + 8 * i, 8).cast("double").alias(c) for i, c in enumerate("xyz")])


def protein_residues(a: DataFrame) -> DataFrame:
    """Residues that hold an atom whose name contains CA."""
    return a.where(F.upper("atom_id").contains("CA")).select("dtag", "model", "chain", "seq_id").distinct()


def protein_atoms(a: DataFrame) -> DataFrame:
    return a.join(protein_residues(a), ["dtag", "model", "chain", "seq_id"], "left_semi")


def review_table(spark: SparkSession, path: str) -> DataFrame:
    """An earlier review table; the schema is stated, never inferred."""
    return spark.read.schema(REVIEW).option("enforceSchema", "false").csv(path, header=True)


def quantiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUANTILES).csv(path, header=True)


def checkpoint(spark: SparkSession, path: str, dtag: str, schema: T.StructType) -> DataFrame:
    """One dataset's events from a store partitioned by dtag; none if it has no partition."""
    return spark.read.schema(schema).parquet(path).where(F.col("dtag") == dtag)


def read_builds(spark: SparkSession, path: str, dtag: str | None = None) -> DataFrame:
    """Autobuilds as they were written, of one dataset or all."""
    rows = spark.read.parquet(path)
    return rows if dtag is None else rows.where(F.col("dtag") == dtag)


def water_free(a: DataFrame) -> DataFrame:
    """Atoms of residues other than water."""
    return a.where(~F.col("residue_name").isin("HOH", "WAT", "DOD"))


def discover_column(df: DataFrame, pairs: tuple[tuple[str, str], ...]) -> tuple[str, str]:
    """The first pair of amplitude and phase labels that a table has."""
    for f, phi in pairs:
        if f in df.columns and phi in df.columns:
            return f, phi
    raise ValueError("no known pair of labels")
