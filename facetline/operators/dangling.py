"""Uses of deleted symbols that nothing replaces: by calls, by references and by imports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from facetline.functions.text import defined_methods, defined_names
from facetline.operators.resolve import STOP_NAMES, inherited_member

#: Uses that are listed per symbol.
MOST_USES = 25
SELF = ("self", "this", "cls")
MODULE = "<module>"


def replaced_by_nothing(deleted: DataFrame, alive: DataFrame, still: DataFrame, bases: DataFrame, members: DataFrame) -> DataFrame:
    """The deleted symbols (id, path, family, name, owner, owner_qual; owner null unless a method) whose uses may dangle.

    Left out: names that are too general, double-underscore names, names that another symbol has (``alive``: family, name);
    functions and classes whose file still exports or binds the name (``still``: path, name); methods that the owner now
    inherits (``bases``, ``members``).
    """
    usable = deleted.where(~F.col("name").isin(STOP_NAMES) & ~F.startswith("name", F.lit("__"))).join(alive.select("family", "name").distinct(), ["family", "name"], "left_anti")
    plain = usable.where("owner IS NULL").join(still.select("path", "name").distinct(), ["path", "name"], "left_anti")
    methods = usable.where("owner IS NOT NULL")
    inherited = inherited_member(methods.select("id", F.col("owner").alias("class"), "name"), bases, members)
    return plain.unionByName(methods.join(inherited.select("id"), "id", "left_anti"))


def without_definition(gone: DataFrame, texts: DataFrame) -> DataFrame:
    """The symbols of ``gone`` (path, name, owner: null unless a method) whose file (path, content) defines their name no more.

    Each text is read once for all names that it defines, for methods and for the rest, and these are joined by file and name.
    Symbols whose file is absent, empty or null stay; a file with several rows defines what any of them does.
    """
    held = texts.join(gone.select("path").distinct(), "path", "left_semi").where("content IS NOT NULL")
    kinds = F.array(F.struct(F.lit(True).alias("method"), defined_methods(F.col("content")).alias("names")), F.struct(F.lit(False).alias("method"), defined_names(F.col("content")).alias("names")))
    defined = held.select("path", F.explode(kinds).alias("k")).select("path", "k.method", F.explode("k.names").alias("name"))
    marked = gone.withColumn("method", F.col("owner").isNotNull())
    return marked.join(defined, ["path", "name", "method"], "left_anti").select(*gone.columns)


def reference_uses(references: DataFrame) -> DataFrame:
    """References (use, path, family, scope, ref, line) as uses: the last part is the name, one part before it the receiver; longer ones mean nothing."""
    parts = F.split("ref", r"\.")
    return references.where(F.size(parts) <= 2).select("use", "path", "family", "scope", F.lit("ref").alias("kind"), F.element_at(parts, -1).alias("name"), F.when(F.size(parts) == 2, F.element_at(parts, 1)).alias("receiver"), "line")


def dangling_uses(gone: DataFrame, uses: DataFrame, locals_: DataFrame, imports: DataFrame, starred: DataFrame, receivers: DataFrame, most: int = MOST_USES) -> DataFrame:
    """(id, path, line) of uses and imports that still mean a symbol of ``gone`` (see ``replaced_by_nothing``), ``most`` per symbol by path and line.

    ``uses``: use, path, family, scope, kind (name, attr, ref …), name, receiver, line. ``imports``: path, family, local, name,
    bound (whether it leads anywhere), module (the file, if it leads to one), means (the file that its text names), line.
    ``receivers``: use, target (a class). ``starred`` (path): files with star imports.

    * a method's use has a receiver: self and the like within the owner's scope, else one whose class is the owner;
    * behind a module's name the name is the module's;
    * a bare name must not be a local of its scope; if imported it must lead nowhere and name the symbol's file, else it
      is the file's own, unless a star import or a module-level name may give it;
    * an import of the name that leads nowhere and names the symbol's file is a use itself.
    """
    targets = gone.select("id", "family", "name", F.col("path").alias("home"), "owner", "owner_qual")
    own = locals_.where(F.col("scope") != MODULE).select("path", "scope", "name").distinct().withColumn("is_local", F.lit(True))
    top = locals_.where(F.col("scope") == MODULE).select("path", "name").distinct().withColumn("is_top", F.lit(True))
    entry = imports.groupBy("path", "local").agg(F.min_by(F.struct("name", "bound", "module", "means"), "line").alias("entry"))
    named = entry.select("path", F.col("local").alias("name"), F.col("entry").alias("by_name"))
    through = entry.select("path", F.col("local").alias("receiver"), F.col("entry.module").alias("through"))
    stars = starred.select("path").distinct().withColumn("starred", F.lit(True))
    of_class = receivers.groupBy("use").agg(F.min("target").alias("on"))

    rows = uses.join(targets, ["family", "name"])
    rows = rows.join(own, ["path", "scope", "name"], "left").join(top, ["path", "name"], "left").join(named, ["path", "name"], "left")
    rows = rows.join(through, ["path", "receiver"], "left").join(stars, "path", "left").join(of_class, "use", "left")
    here = F.col("path") == F.col("home")
    method = F.col("kind").isin("attr", "ref") & F.when(F.split_part("receiver", F.lit("."), F.lit(1)).isin(*SELF), here & F.col("receiver").isin(*SELF) & F.startswith("scope", F.concat("owner_qual", F.lit(".")))).otherwise(F.col("on") == F.col("owner"))
    imported = (F.col("by_name.name") == F.col("name")) & ~F.col("by_name.bound") & (F.col("by_name.means") == F.col("home"))
    in_module = F.when(F.col("scope") == MODULE, F.col("is_top")).otherwise(F.col("is_local"))
    bare = (F.col("kind") != "attr") & in_module.isNull() & F.when(F.col("by_name").isNotNull(), imported).otherwise(here & F.col("starred").isNull() & F.col("is_top").isNull())
    plain = F.when(F.col("receiver").isNull(), bare).otherwise(~F.contains("receiver", F.lit(".")) & (F.col("through") == F.col("home")))
    ok = F.when(F.col("owner").isNotNull(), F.col("receiver").isNotNull() & method).otherwise(plain)
    hits = rows.where(F.coalesce(ok, F.lit(False))).select("id", "path", "line")
    by_import = imports.where("NOT bound").join(targets.where("owner IS NULL").select("id", "family", "name", F.col("home").alias("means")), ["family", "name", "means"]).select("id", "path", "line")
    once = hits.unionAll(by_import).distinct()
    return once.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy("path", "line"))).where(F.col("rank") <= most).select("id", "path", "line")
