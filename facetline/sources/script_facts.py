"""Facts of JavaScript and TypeScript files: symbols, imports, exports, calls, references, locals and types.

Texts are tables of tokens (:mod:`facetline.sources.script_tokens`). Statements, and their parts between commas, are runs of
neighbours within one box, written as one line of tokens with a blank between them; a bracket stands there for its whole
box. Patterns over these lines find declarations wherever their text is broken. Symbols are stretches of tokens, and every
token belongs to the innermost symbol around it. What needs neighbours in a box is found where the file is read
(:mod:`facetline.sources.token_boxes`); all further steps are DataFrame expressions and joins on (file, place), for which
patterns choose the lines and take what is needed of them first, so that no whole lines are shuffled.

There is no full grammar: words of texts within elements are passed over by the balance of tags, type arguments by the
marks that may stand in them, and a comma within type arguments ends a part.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from facetline.functions.text import normalize_type
from facetline.operators.staging import job_of, materialise, measured_joins, within
from facetline.sources import token_boxes
from facetline.sources.script_tokens import NAME, placed_tokens, texts
from facetline.sources.token_boxes import RESERVED

MODULE = "<module>"
# Words that may stand before a member's name, before a parameter that is a field, before a condition,
# types of the language itself, and names that mean something where they stand.
MODIFIERS = "public private protected static readonly override abstract declare async get set accessor".split()
ACCESS = "public private protected readonly override".split()
BRANCHES = "if for while switch with".split()
PREDEFINED = "any number boolean string symbol unknown never object".split()
CONTEXTUAL = "as from of type get set async static public private protected readonly abstract declare keyof infer is satisfies implements namespace override accessor interface enum".split()

_EXPORT = r"(?:export )?(?:default )?(?:declare )?"
_DECLARES = r"^(?:export|default|declare|async|function|abstract|class|interface|type|enum|const|let|var|module|exports)\b"
_VAR = r"(?:export )?(?:declare )?(?:const|let|var) "
_GENERIC = r"(?:<\S* (?:[^()]*? )?> )?"
_FUNCTION = rf"(?:async )?(?:function\b|{_GENERIC}(?:\(|{NAME})(?: : [^;=]*?)? =>)"
_WRAPPED = rf"(?!new |await )(?:{NAME}|this)(?: (?:\.|\?\.) {NAME}| \(|(?: <\S* [^()]*?>))* \( ?;?$"
_MOD = rf"(?:@{NAME} (?:\. {NAME} )*(?:\( )?)*(?:(?:{'|'.join(MODIFIERS)}) )*(?:\* )?"
_KEY = rf"#?{NAME}"
_IDENT = rf"^(?!(?:{'|'.join(RESERVED)})$)(?:[\p{{L}}_$]|[#@].)"
_CHAIN = rf"{NAME}(?: (?:\.|\?\.) #?{NAME})*"


@dataclass(frozen=True)
class Script:
    """All tables are written when they are asked for. texts: path, ts; tokens; statements and parts: path, box, stmt (and item), s (the line of tokens), ks, ts (their places and texts), line, last, end (last place);
    given: path, last_box of the boxes that have a function as an argument;
    symbols: path, k, name (qualified), own, kind, parent, start, end, from, to (places), body (place of its members' or body's box), returns."""

    texts: DataFrame
    #: The folder of the job that it belongs to.
    job: str | None = None

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        with within(self.job):
            return materialise(df, name)

    @cached_property
    def tokens(self) -> DataFrame:
        with within(self.job):
            return placed_tokens(self.texts)

    # a file is a row of the texts, so its statements and parts are made where it is read
    @cached_property
    def statements(self) -> DataFrame:
        return self._written(self.texts.mapInArrow(token_boxes.statements, token_boxes.LINES), "statements")

    @cached_property
    def parts(self) -> DataFrame:
        return self._written(self.texts.mapInArrow(token_boxes.parts, token_boxes.PART_LINES), "parts")

    @cached_property
    def given(self) -> DataFrame:
        return self._written(self.parts.where(_has("function", "=>") & F.col("s").rlike(rf"^{_FUNCTION}")).select("path", F.col("box").alias("last_box")).distinct(), "giving-boxes")

    @cached_property
    def symbols(self) -> DataFrame:
        with within(self.job):
            return materialise(_declared(self), "symbols")


def _first(pattern: str, group: int = 1, column: str = "s") -> Column:
    return F.nullif(F.regexp_extract(column, pattern, group), F.lit(""))


def _after(prefix: str, column: str = "s") -> Column:
    """Number of tokens that a pattern takes; it ends with the blank before the next one."""
    return F.length(F.regexp_replace(F.regexp_extract(column, prefix, 0), "[^ ]", ""))


def _has(*texts: str) -> Column:
    """Whether a line has one of these texts, which is asked before a pattern that needs one is tried."""
    return reduce(Column.__or__, [F.contains("s", F.lit(x)) for x in texts])


def _has_body() -> Column:
    return F.endswith("s", F.lit("{")) | F.endswith("s", F.lit("{ ;"))


def _at(prefix: str, of: str = "ks") -> Column:
    return F.get(of, _after(prefix))


def _unquoted(t: Column) -> Column:
    return F.regexp_replace(t, r"""^['"`]|['"`]$""", "")


def _last_box() -> Column:
    """The place of the last token of a line but for an end mark."""
    return F.when(F.col("s").rlike(" ;$"), F.element_at("ks", -2)).otherwise(F.element_at("ks", -1))


def read(files: DataFrame) -> Script:
    """The script files (path, content), as much of them as is asked for; the tables are in the shared folder."""
    measured_joins(files.sparkSession)
    return Script(texts(files), job_of())


def parse(files: DataFrame) -> Script:
    """The script files (path, content) as statements, parts and symbols; the tables are in the shared folder."""
    script = read(files)
    for table in ("statements", "parts", "symbols"):
        getattr(script, table)
    return script


def _declared(script: Script) -> DataFrame:
    parts, given = script.parts.where("box >= 0"), script.given
    top = script.statements.where("box = -1").where(F.col("s").rlike(_DECLARES))

    var = rf"^{_VAR}(?={NAME})"
    value = rf"^{_VAR}{NAME} (?:: .*? )?= "
    s = F.col("s")
    is_function, is_wrapped = (lambda prefix: s.rlike(prefix + _FUNCTION)), lambda prefix: s.rlike(prefix + _WRAPPED)
    assigned = rf"^(?:module \. )?exports(?: \. {NAME})? = "
    default = r"^export default "
    kinds = [
        ("function", rf"^{_EXPORT}(?:async )?function\b", F.lit(True), rf"^{_EXPORT}(?:async )?function (?:\* )?(?={NAME})", rf"^{_EXPORT}"),
        ("class", rf"^{_EXPORT}(?:abstract )?class\b", F.lit(True), rf"^{_EXPORT}(?:abstract )?class (?={NAME})(?!extends|implements)", rf"^{_EXPORT}"),
        ("interface", rf"^{_EXPORT}interface {NAME}", F.lit(True), rf"^{_EXPORT}interface ", rf"^{_EXPORT}"),
        ("type", rf"^{_EXPORT}type {NAME} (?:<|=)", F.lit(True), rf"^{_EXPORT}type ", rf"^{_EXPORT}"),
        ("enum", rf"^{_EXPORT}(?:const )?enum {NAME}", F.lit(True), rf"^{_EXPORT}(?:const )?enum ", rf"^{_EXPORT}"),
        ("function", var, is_function(value), var, r"^(?:export )?(?:declare )?"),
        ("class", value + r"class\b", F.lit(True), var, value),
        ("object", value + r"\{(?: as const| satisfies .*)?(?: ;)?$", F.lit(True), var, r"^(?:export )?(?:declare )?"),
        ("function", assigned + _FUNCTION, F.lit(True), None, r"^"),
        ("function", default + rf"{_FUNCTION}", F.lit(True), None, default),
    ]
    # a call is a function only if it is given one, which its box says; so lines of calls wait for that, others don't
    wrapped = next(i for i, (_, name, also, *_) in enumerate(kinds) if name == var)
    which = F.coalesce(*[F.when(s.rlike(pattern) & also, i) for i, (_, pattern, also, *_) in enumerate(kinds)])
    first_place = F.get("ks", F.lit(0)).alias("k")
    held = top.select("path", first_place, "s", "ks", "ts", "lines", "last", "end", _last_box().alias("last_box"), which.alias("which"), is_wrapped(value).alias("waits"))
    held = materialise(held, "declarations").withColumn("waits", F.col("waits") & (F.col("which").isNull() | (F.col("which") > wrapped)))
    met = held.where("waits").join(given.withColumn("gives", F.lit(True)), ["path", "last_box"], "left").withColumn("which", F.when(F.col("gives"), wrapped).otherwise(F.col("which"))).drop("gives")
    own_of = {
        i: (_at(name, "ts") if name and kind not in ("function", "class") else F.when(s.rlike(name), _at(name, "ts")).otherwise("default") if name else F.when(s.rlike(default), "default").otherwise(F.coalesce(_first(rf"exports \. ({NAME}) ="), F.lit("default"))))
        for i, (kind, _, _, name, _) in enumerate(kinds)
    }
    chosen = lambda values: F.coalesce(*[F.when(F.col("which") == i, v) for i, v in values.items()])
    of_kind = lambda column: chosen({i: _at(start, column) for i, (*_, start) in enumerate(kinds)})
    own = chosen(own_of)
    outer = held.where("NOT waits").unionByName(met).where("which IS NOT NULL").select("path", "k", own.alias("name"), own.alias("own"), chosen({i: F.lit(kind) for i, (kind, *_) in enumerate(kinds)}).alias("kind"), F.lit(None).cast("string").alias("parent"), of_kind("lines").alias("start"), F.col("last").alias("end"), of_kind("ks").alias("from"), F.col("end").alias("to"), F.col("last_box").alias("body"), "s", "ts")
    outer = materialise(outer, "outer-symbols")

    box_of = outer.where("kind IN ('class', 'object')").select("path", F.col("body").alias("box"), F.col("name").alias("parent"), F.col("kind").alias("of"))
    method = rf"^{_MOD}(?={_KEY} (?:< .*?> )?\( (?:: .*)?\{{(?: ;)?$)"
    field = rf"^{_MOD}(?={_KEY} (?:[?!] )?(?:: .*? )?= )"
    field_value = rf"^{_MOD}{_KEY} (?:[?!] )?(?:: .*? )?= "
    shorthand = rf"^(?:(?:async|get|set) )*(?:\* )?(?={NAME} (?:< .*?> )?\( (?:: .*)?\{{$)"
    pair, pair_value = rf'^(?={NAME} : |" : )', rf'^(?:{NAME}|") : '

    def members(lines: DataFrame, of: str, mark: str, sure: str, maybe: str, maybe_value: str, maybe_at: Column) -> DataFrame:
        """The lines of boxes ``of`` classes or objects with the place at of their member's name; waits: it is one if its last box is given a function."""
        kept = lines.where(_has_body() | _has(mark)).where(s.rlike(sure) | (s.rlike(maybe) & (is_function(maybe_value) | is_wrapped(maybe_value))))
        at = F.when(s.rlike(sure), _after(sure)).otherwise(maybe_at)
        own = _unquoted(F.get("ts", at))
        kept = kept.select("path", "box", first_place, own.alias("own"), F.get("lines", F.lit(0)).alias("start"), "last", "end", _last_box().alias("last_box"), "s", "ts", (~s.rlike(sure) & ~is_function(maybe_value)).alias("waits"))
        return kept.where(~F.col("own").isin(BRANCHES)).join(box_of.where(F.col("of") == of).drop("of"), ["path", "box"])

    found = members(script.statements.where("box >= 0"), "class", " = ", method, field, field_value, _after(field)).unionByName(members(parts, "object", " : ", shorthand, pair, pair_value, F.lit(0)))
    found = materialise(found, "members")
    both = found.where("NOT waits").unionByName(found.where("waits").join(given, ["path", "last_box"], "left_semi"))
    inner = both.select("path", "k", F.concat_ws(".", "parent", "own").alias("name"), "own", F.lit("method").alias("kind"), "parent", "start", F.col("last").alias("end"), F.col("k").alias("from"), F.col("end").alias("to"), F.col("last_box").alias("body"), "s", "ts")
    inner = materialise(inner, "inner-symbols")
    # an object is a symbol if it has a function among its members
    with_members = inner.select("path", F.col("parent").alias("name")).distinct()
    every = outer.where("kind <> 'object'").unionByName(outer.where("kind = 'object'").join(with_members, ["path", "name"], "left_semi")).unionByName(inner)
    returns = F.when(F.col("kind").isin("function", "method"), F.array_join(F.slice("ts", _after(r"^.*?\( : (?=.*(?:\{|=>))") + 1, F.greatest(F.lit(0), _after(r"^.*?\( : (?:(?!=> )[^{])*? (?=\{|=>)") - _after(r"^.*?\( : (?=.*(?:\{|=>))"))), ""))
    every = every.withColumn("returns", F.nullif(returns, F.lit("")))
    first = F.row_number().over(W.partitionBy("path", "name").orderBy("k"))
    return every.withColumn("n", first).where("n = 1").drop("n")


def symbols(script: Script) -> DataFrame:
    """path, name, kind, start, end: declarations, and methods, function fields and function members as Container.member; the first of a name counts."""
    return script.symbols.select("path", "name", "kind", "start", "end")


def modules(files: DataFrame) -> DataFrame:
    """path, name, kind, start, end: every file as a symbol of its own."""
    return files.where("content IS NOT NULL").select("path", F.lit(MODULE).alias("name"), F.lit("module").alias("kind"), F.lit(1).alias("start"), F.size(F.split("content", "\n")).alias("end"))


def bases(script: Script) -> DataFrame:
    """path, name, base: what a class extends and implements, and each of what an interface extends, without type arguments."""
    head = script.symbols.where("kind IN ('class', 'interface')").select("path", "name", F.array_join("ts", " ").alias("s"), "kind")
    listed = F.coalesce(_first(r"\bextends (.*?)(?: implements .*)? \{(?: ;)?$"), F.lit(""))
    also = F.coalesce(_first(r"\bimplements (.*?) \{(?: ;)?$"), F.lit(""))
    bare = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r" <[^<>]*>", ""), r" <.*?>(?= ,|$)", ""), r" \.\s", ".")
    rows = head.select("path", "name", F.explode(F.concat(F.split(bare(listed), " , "), F.split(bare(also), " , "))).alias("base"))
    return rows.where(F.col("base").rlike(rf"^{NAME}(?:\.{NAME})*$"))


def static_members(script: Script) -> DataFrame:
    """path, owner, member, target: assignments Owner.Member = Target at the top of a file."""
    pattern = rf"^({NAME}) \. ({NAME}) = ({_CHAIN})(?: ;)?$"
    held = script.statements.where("box = -1")
    rows = held.select("path", _first(pattern).alias("owner"), _first(pattern, 2).alias("member"), F.regexp_replace(_first(pattern, 3), r" (?:\?)?(\.) ", "$1").alias("target"))
    return rows.where("owner IS NOT NULL AND owner NOT IN ('module', 'exports', 'this')")


def imports(script: Script) -> DataFrame:
    """path, local, module, name: default and named imports, namespaces (*), and required modules."""
    st = script.statements
    s = F.col("s")
    is_import = (F.col("box") == -1) & s.rlike(r'^import (?:type )?(?:.* )?from "')
    head = st.where(is_import).withColumn("module", _unquoted(F.element_at(F.filter("ts", lambda t: t.rlike(r"""^['"]""")), -1)))
    default = F.when(s.rlike(rf"^import (?:type )?{NAME} (?:,|from)"), F.when(s.rlike(rf"^import type {NAME} "), F.get("ts", F.lit(2))).otherwise(F.get("ts", F.lit(1))))
    plain = head.select("path", "module", default.alias("default"), _first(rf"\* as ({NAME}) ").alias("whole"), F.when(s.contains("{"), _at(r"^import [^{]*(?=\{)")).alias("braces"))
    required = rf'^{_VAR}(.*) = require \((?: ;)?$'
    asked = st.where(_has("require (") & s.rlike(required)).withColumn("spec_box", _at(rf"^{_VAR}.* = require "))
    held_in = script.parts.where("box >= 0").where(s.contains('"')).select("path", F.col("box").alias("spec_box"), F.explode(F.arrays_zip("ks", "ts", F.split("s", " ").alias("w"))).alias("x"))
    strings = held_in.select("path", "spec_box", F.col("x.ks").alias("k"), F.col("x.ts").alias("t"), F.col("x.w").alias("w")).where("w = '\"' AND length(t) > 1")
    spec = strings.groupBy("path", "spec_box").agg(F.min_by("t", "k").alias("spec"))
    asked = asked.select("path", "spec_box", F.lit(None).cast("string").alias("default"), _first(rf"^{_VAR}({NAME}) (?:: .*? )?= ").alias("whole"), F.when(s.rlike(rf"^{_VAR}\{{"), _at(rf"^{_VAR}")).alias("braces"))
    asked = asked.join(spec, ["path", "spec_box"]).withColumn("module", _unquoted(F.col("spec"))).drop("spec_box", "spec")
    held = plain.unionByName(asked)
    one = held.select("path", "module", F.explode(F.filter(F.array(F.struct(F.col("default").alias("local"), F.lit("default").alias("name")), F.struct(F.col("whole").alias("local"), F.lit("*").alias("name"))), lambda x: x["local"].isNotNull())).alias("i")).select("path", "i.local", "module", "i.name")
    part = rf"^(?:type )?({NAME}|default)(?: (?:as|:) ({NAME}))?"
    listed = script.parts.where("box >= 0").where(s.rlike(part)).select("path", F.col("box").alias("braces"), F.coalesce(_first(part, 2), _first(part)).alias("local"), _first(part).alias("name"))
    named = held.where("braces IS NOT NULL").select("path", "braces", "module").join(listed, ["path", "braces"]).select("path", "local", "module", "name")
    return one.unionByName(named)


def exports(script: Script) -> DataFrame:
    """path, exported, local, module, ord: what a file exports, by a local name or from another module.

    A star export is (*, *, module), by its place in the file, one under a name (name, *, module); a default whose value is an expression gives its
    names from the last to the first, by ``ord``.
    """
    st, s = script.statements.where("box = -1"), F.col("s")
    none = F.lit(None).cast("string")
    row = lambda exported, local, module=none, ord_=F.lit(0): [exported.alias("exported"), local.alias("local"), module.alias("module"), ord_.cast("int").alias("ord")]
    from_ = F.when(s.rlike(r'(?:^| )from "'), _unquoted(F.element_at(F.filter("ts", lambda t: t.rlike(r"""^['"]""")), -1)))
    tops = script.symbols.where("parent IS NULL").select("path", "k", "name")
    declared = st.where(s.rlike("^export ")).select("path", F.get("ks", F.lit(0)).alias("k"), s.rlike("^export default ").alias("is_default")).join(tops, ["path", "k"])
    of_symbols = declared.select("path", *row(F.col("name"), F.col("name"))).unionByName(declared.where("is_default").select("path", *row(F.lit("default"), F.col("name")))).distinct()
    plain = st.where(s.rlike(rf"^export (?:declare )?(?:const|let|var) {NAME}")).select("path", F.get("ks", F.lit(0)).alias("k"), _first(rf"^{_VAR}({NAME})").alias("name"))
    of_values = plain.join(tops.select("path", "k"), ["path", "k"], "left_anti").select("path", *row(F.col("name"), F.col("name")))
    star = st.where(s.rlike(r"^export (?:type )?\* ")).select("path", *row(F.coalesce(_first(rf"^export (?:type )?\* as ({NAME}|default)"), F.lit("*")), F.lit("*"), from_, F.when(s.rlike(r"^export (?:type )?\* from"), F.get("ks", F.lit(0))).otherwise(0)))
    lists = st.where(s.rlike(r"^export (?:type )?\{")).select("path", F.when(s.rlike("^export type "), F.get("ks", F.lit(2))).otherwise(F.get("ks", F.lit(1))).alias("box"), from_.alias("module"))
    part = rf"^(?:type )?({NAME}|default)(?: as ({NAME}|default))?"
    inside = script.parts.where("box >= 0")
    named = inside.where(s.rlike(part)).select("path", "box", F.coalesce(_first(part, 2), _first(part)).alias("exported"), _first(part).alias("local"))
    listed = lists.join(named, ["path", "box"]).select("path", *row(F.col("exported"), F.col("local"), F.col("module")))
    value = rf"^(?:export default|module \. exports =) ({NAME})(?: ;)?$"
    is_default = s.rlike(value)
    of_default = st.where(is_default).select("path", *row(F.lit("default"), _first(value)))
    # other expressions: all their names, wherever in their brackets
    other = st.where(s.rlike(r"^export default ") & ~is_default & ~s.rlike(rf"^export default (?:(?:abstract )?class\b|{_FUNCTION})")).select("path", F.get("ks", F.lit(0)).alias("from"), F.col("end").alias("to"))
    # what stands within is what statements of deeper boxes have, so their names are taken only where such an expression is in the file
    holding = script.statements.select("path", "s", "ks", "ts").join(other.select("path").distinct(), "path", "left_semi")
    w = F.split("s", " ")
    beside = F.arrays_zip("ks", "ts", w.alias("w"), F.concat(F.array(none), w).alias("prev"), F.slice(w, 2, 2**30).alias("next"))
    tokens = holding.select("path", F.explode(beside).alias("x")).select("path", F.col("x.ks").alias("k"), F.col("x.ts").alias("t"), "x.w", "x.prev", "x.next")
    tokens = tokens.where(F.col("w").rlike(_IDENT)).where("(prev IS NULL OR prev NOT IN ('.', '?.')) AND (next IS NULL OR next <> ':')").select("path", "k", "t")
    idents = tokens.join(other, "path").where("k > from AND k <= to")
    guessed = idents.select("path", *row(F.lit("default"), F.col("t"), none, F.row_number().over(W.partitionBy("path").orderBy(F.desc("k"))) - 1))
    assigned = rf"^(?:module \. )?exports \. ({NAME}) = "
    given = st.where(s.rlike(assigned)).select("path", *row(_first(assigned), F.when(s.rlike(assigned + _FUNCTION), _first(assigned)).otherwise(F.coalesce(_first(assigned + rf"({NAME})(?: ;)?$", 2), _first(assigned)))))
    objects = st.where(s.rlike(r"^module \. exports = \{")).select("path", F.get("ks", F.lit(4)).alias("box"))
    member = rf'^({NAME})(?: : ({NAME}))?$'
    named = inside.where(s.rlike(member)).select("path", "box", _first(member).alias("exported"), F.coalesce(_first(member, 2), _first(member)).alias("local"))
    of_object = objects.join(named, ["path", "box"]).select("path", *row(F.col("exported"), F.col("local")))
    return reduce(DataFrame.unionByName, [of_symbols, of_values, star, listed, of_default, guessed, given, of_object])


def scoped(script: Script, rows: DataFrame, without: DataFrame | None = None, lists: DataFrame | None = None) -> DataFrame:
    """``rows`` (path, k) with scope (the innermost symbol around each place, or the module) and scope_kind; the head of a class is outside of it.

    Rows at the places ``without`` (path, k) are left out, and those at or right within the places at the top of a file ``lists`` (path, k), for which
    rows have their box. All this is one shuffle of the rows, by file.
    """
    y = script.symbols.withColumn("from", F.when(F.col("kind") == "class", F.col("body")).otherwise(F.col("from")))
    mark = F.struct("name", "kind", "to")
    marks = y.select("path", F.col("from").alias("k"), F.when(F.col("parent").isNull(), mark).alias("outer"), F.when(F.col("parent").isNotNull(), mark).alias("inner"), F.lit(0).alias("is_row"))
    columns = ["outer", "inner"]
    # symbols, and places without rows, stand before what stands at their place
    both = rows.withColumn("is_row", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    for name, places in (("out", without), ("listed", lists)):
        if places is not None:
            both = both.unionByName(places.select("path", "k", F.col("k").alias(name), F.lit(0).alias("is_row")), allowMissingColumns=True)
            columns.append(name)
    upto = W.partitionBy("path").orderBy("k", "is_row").rowsBetween(W.unboundedPreceding, 0)
    both = both.withColumns({c: F.last(c, ignorenulls=True).over(upto) for c in columns}).where("is_row = 1")
    if without is not None:
        both = both.where("out IS NULL OR out <> k")
    if lists is not None:
        # nothing of the top stands between a bracket there and what is in it
        both = both.where("listed IS NULL OR (listed <> k AND listed <> box)")
    held = lambda name: F.when(F.col("k") <= F.col(f"{name}.to"), F.col(name))
    of = F.coalesce(held("inner"), held("outer"))
    return both.withColumn("of", of).withColumn("scope", F.coalesce("of.name", F.lit(MODULE))).withColumn("scope_kind", F.coalesce("of.kind", F.lit("module"))).drop(*columns, "of", "is_row")


def _mentions(script: Script) -> DataFrame:
    """The rows of ``chains`` without scopes, as they are read."""
    rows = script.texts.mapInArrow(token_boxes.chains, token_boxes.CHAINS).withColumn("dangling", F.startswith("text", F.lit(".")))
    used = F.coalesce(F.col("then").isin("(", "`("), F.lit(False)) | F.coalesce(F.col("prev") == "new", F.lit(False)) | ((F.col("kind") == "name") & ~F.col("dangling"))
    return rows.where((F.col("kind") == "tag") | (used & ~F.col("in_text") & ~F.col("in_tag") & ~_definition())).drop("in_text", "in_tag")


def chains(script: Script) -> DataFrame:
    """Names and the dotted names that go on from them, and elements, as far as they are called or mentioned, for all facts of them; a table in the shared folder.

    path, scope, scope_kind, box, k (first place), line, run_line (where its whole expression begins), text, dangling (it goes on from an
    expression), kind (name, word, mark, tag for an element) and prev, prev2 of its first token, then (what follows, type arguments passed over), next, next2, starts
    (first of its part). One fact alone gives scopes only to the rows that it needs.
    """
    return materialise(scoped(script, _mentions(script)), "chains")


def _member_names(script: Script) -> DataFrame:
    """path, k: the names of all that stands in bodies of classes, interfaces and enumerations; a place may come more than once."""
    bodies = script.symbols.where("kind IN ('class', 'interface', 'enum')").select("path", F.col("body").alias("box"))
    first = script.parts.where("box >= 0").select("path", "box", _at(rf"^{_MOD}(?={_KEY}\b)").alias("k"))
    return first.join(bodies, ["path", "box"]).select("path", "k").where("k IS NOT NULL")


def _definition() -> Column:
    """Whether a chain is the name in a definition: after function or class, or with parameters and a body."""
    named = F.col("prev").isin("function", "class", "interface", "enum") | ((F.col("prev") == "*") & (F.col("prev2") == "function")) | ((F.col("prev") == "type") & F.col("next").isin("=", "<"))
    with_body = (F.col("next") == "(") & (F.col("next2") == "{") & ~F.contains("text", F.lit(".")) & (F.col("starts") | F.col("prev").isin(*MODIFIERS, "*"))
    return F.coalesce(named, F.lit(False)) | F.coalesce(with_body, F.lit(False))


def calls(script: Script, chain_rows: DataFrame | None = None) -> DataFrame:
    """path, k (place), line, scope, name, kind (name, attr, new, jsx, super), receiver (null for none, and for any expression)."""
    every = _mentions(script) if chain_rows is None else chain_rows
    text, head = F.col("text"), F.split_part("text", F.lit("."), F.lit(1))
    last = F.regexp_extract("text", r"[^.]*$", 0)
    rest = F.nullif(F.regexp_replace("text", r"\.?[^.]*$", ""), F.lit(""))
    is_tag = F.col("kind") == "tag"
    made = F.coalesce(F.col("prev") == "new", F.lit(False))
    called = F.coalesce(F.col("then").isin("(", "`("), F.lit(False)) & ~made
    own_word = F.col("kind") == "word"
    usable = F.col("dangling") | ~own_word | head.isin("this", "super")
    on_super = F.col("text").rlike(rf"^super\.#?{NAME}$")
    kind = F.when(made, "new").when(text == "super", "super").when(on_super, "super").when(F.col("dangling") | F.contains("text", F.lit(".")), "attr").otherwise("name")
    name = F.when(text == "super", "constructor").otherwise(last)
    receiver = F.when(F.col("dangling") | (kind == "super") | F.startswith("text", F.lit("super.")), F.lit(None).cast("string")).otherwise(rest)
    line = F.when(F.col("dangling"), F.col("run_line")).otherwise(F.col("line"))
    tag = F.regexp_extract("text", rf"^<({NAME}(?:\.{NAME})*)$", 1)
    of_tag = F.nullif(F.regexp_replace(tag, r"\.?[^.]*$", ""), F.lit(""))
    # calls and elements are chosen from one reading of the files
    rows = every.where(F.when(is_tag, tag.rlike(r"^\p{Lu}")).otherwise((called | made) & usable & ~text.isin("require", "this", "import", "async")))
    either = lambda element, call: F.when(is_tag, element).otherwise(call)
    rows = rows.select("path", "k", either(F.col("line"), line).alias("line"), either(F.regexp_extract(tag, r"[^.]*$", 0), name).alias("name"), either(F.lit("jsx"), kind).alias("kind"), either(of_tag, receiver).alias("receiver"), *([] if chain_rows is None else ["scope"]))
    held = scoped(script, rows, _member_names(script)) if chain_rows is None else rows.join(_member_names(script), ["path", "k"], "left_anti")
    return held.select("path", "k", "line", "scope", "name", "kind", "receiver")


def bound_names(script: Script) -> DataFrame:
    """path, k, name, how (parameter, variable, or top: a variable at the top of a file): names that parameters and declared variables bind, patterns expanded;
    a table in the shared folder.

    A box is a pattern if it is a list of parameters, stands for a declared variable, or is in a pattern at a place that binds.
    """
    s = F.col("s")
    at_hand = materialise(script.texts.mapInArrow(token_boxes.places, token_boxes.PLACES), "places")
    lists = at_hand.where("what = 'list'").select("path", F.col("k").alias("box"))
    method = rf"^{_MOD}{_KEY} (?:< .*?> )?(?=\( (?:: .*)?\{{(?: ;)?$)"
    methods = script.statements.where("box >= 0").where(_has_body() & s.rlike(method)).select("path", "box", _at(rf"^{_MOD}{_KEY} (?:< .*?> )?(?=\()").alias("list"))
    members = methods.join(script.symbols.where("kind = 'class'").select("path", F.col("body").alias("box")), ["path", "box"]).select("path", F.col("list").alias("box"))
    lists = lists.unionByName(members).distinct().select("path", "box", F.lit("(").alias("mark"))
    single = at_hand.where("what = 'single'").select("path", "k", "name", F.lit("parameter").alias("how"))
    # declared variables: every part of a statement that begins with const, let or var
    heads = script.statements.where(s.rlike(rf"^{_VAR}")).select("path", "box", "stmt")
    start = rf"^(?:{_VAR})?"
    simple = rf"{start}(?={NAME}(?: [!])?(?: :.*?)?(?: =.*| ;|)$)"
    opens = start + r"(?=[\[{])"
    d = script.parts.where(s.rlike(simple) | s.rlike(opens)).select("path", "box", "stmt", F.when(s.rlike(opens), _at(opens)).otherwise(_at(simple)).alias("k"), F.when(s.rlike(opens), _at(opens, "ts")).otherwise(_at(simple, "ts")).alias("name"), s.rlike(opens).alias("is_pattern"))
    d = materialise(d.join(heads, ["path", "box", "stmt"]), "declared-variables")
    variables = d.where("NOT is_pattern").select("path", "k", "name", F.when(F.col("box") == -1, "top").otherwise("variable").alias("how"))
    patterns = d.where("is_pattern").select("path", F.col("k").alias("box"), F.col("name").alias("mark"))
    lead = rf"^(?:@{NAME} (?:\( )?)*(?:(?:{'|'.join(ACCESS)}) )*(?:\.\.\. )?"
    # what a part binds, by the mark of its box, as far as it is a name or a further pattern
    keyed = rf'^(?:{NAME}|"|0|\[) : '
    binds = lambda place: F.struct(F.get("ks", place).alias("k"), F.get("ts", place).alias("name"))
    binding = materialise(script.parts.where("box >= 0").select("path", "box", binds(_after(lead)).alias("plain"), F.when(_has(" : ") & s.rlike(keyed), binds(_after(keyed))).alias("keyed")), "bindings")
    within_box = lambda rows, boxes: rows.join(boxes, ["path", "box"]).select("path", F.when(F.col("mark") == "{", F.coalesce("keyed", "plain")).otherwise(F.col("plain")).alias("x")).select("path", "x.k", "x.name")
    # rounds go from pattern to pattern, by the few parts that bind one; names are met once
    inner = materialise(binding.where("plain.name IN ('[', '{') OR keyed.name IN ('[', '{')"), "inner-patterns")
    levels = [materialise(lists.unionByName(patterns), "patterns")]
    while not levels[-1].isEmpty():
        further = within_box(inner, levels[-1]).where("name IN ('[', '{')")
        levels.append(materialise(further.select("path", F.col("k").alias("box"), F.col("name").alias("mark")), "patterns"))
    named = within_box(binding, reduce(DataFrame.unionByName, levels).distinct()).where(F.col("name").rlike(f"^{NAME}$") & ~F.col("name").isin(RESERVED))
    found = [single, variables, named.withColumn("how", F.lit("parameter"))]
    return materialise(reduce(DataFrame.unionByName, found).distinct(), "bound-names")


def locals_(script: Script, bound: DataFrame | None = None) -> DataFrame:
    """path, scope, name: what parameters and variables of functions bind; nested functions count to the symbol around them."""
    held = scoped(script, (bound_names(script) if bound is None else bound).where("how <> 'top'"))
    return held.where("scope_kind NOT IN ('module', 'class')").select("path", "scope", "name").distinct()


def references(script: Script, chain_rows: DataFrame | None = None, bound: DataFrame | None = None) -> DataFrame:
    """path, scope, name: dotted names that are mentioned and neither called, declared nor assigned to."""
    c = _mentions(script) if chain_rows is None else chain_rows
    b = bound_names(script) if bound is None else bound
    plain = c.where("NOT dangling AND kind = 'name'")
    key = F.col("starts") & (F.coalesce(F.col("next") == ":", F.lit(False)) | (F.coalesce(F.col("next") == "?", F.lit(False)) & F.coalesce(F.col("next2") == ":", F.lit(False)))) & (F.col("box") >= 0)
    target = F.coalesce(F.col("next").isin("=", "=>"), F.lit(False)) & ~F.coalesce(F.col("prev") == ":", F.lit(False))
    called = F.coalesce(F.col("then").isin("(", "`("), F.lit(False)) | F.coalesce(F.col("prev") == "new", F.lit(False))
    rows = plain.where(~key & ~target & ~called & ~F.col("text").isin(CONTEXTUAL + PREDEFINED))
    # lists of imports and exports mention nothing
    lists = script.statements.where((F.col("box") == -1) & F.col("s").rlike(r"^(?:import |export (?:type )?(?:\{|\*))")).select("path", F.explode("ks").alias("k"))
    without = b.select("path", "k").unionByName(_member_names(script))
    if chain_rows is None:
        held = scoped(script, rows.select("path", "box", "k", "text"), without, lists)
    else:
        held = rows.join(without, ["path", "k"], "left_anti").join(lists, ["path", "k"], "left_anti").join(lists.withColumnRenamed("k", "box"), ["path", "box"], "left_anti")
    return held.select("path", "scope", F.col("text").alias("name")).distinct()


def accessor_parameters(script: Script) -> DataFrame:
    """path, line, field, type: constructor parameters with an access modifier, which declare fields of their class."""
    s = F.col("s")
    held = script.statements.where("box >= 0").where(_has("constructor (") & s.rlike(rf"^{_MOD}constructor \(")).select("path", "box", _at(rf"^{_MOD}constructor (?=\()").alias("list"))
    lists = held.join(script.symbols.where("kind = 'class'").select("path", F.col("body").alias("box"), F.col("name").alias("class")), ["path", "box"]).select("path", F.col("list").alias("box"), "class")
    pattern = rf"^(?:@{NAME} (?:\( )?)*(?:(?:{'|'.join(ACCESS)}) )+(?={NAME})"
    kind = F.regexp_replace(_first(rf"{pattern}{NAME} (?:\? )?: ({_CHAIN})"), r" (\.) ", "$1")
    rows = script.parts.where("box >= 0").where(_has(" : ") & s.rlike(rf"{pattern}{NAME} (?:\? )?: ")).select("path", "box", _at(pattern, "lines").alias("line"), _at(pattern, "ts").alias("field"), kind.alias("type"))
    return rows.join(lists, ["path", "box"]).select("path", "line", "class", "field", "type").where("type IS NOT NULL")


_ROOT = rf"(?:await )*(?:new )?({_CHAIN})(?: <[^()]*?>)? \((?: \(| \[| !| (?:\.|\?\.) #?{NAME})*(?: ;)?$"


def variable_types(script: Script) -> DataFrame:
    """path, scope, var, type, ord: the class that an annotation, or what a value is made by, names; ``this.x`` in the scope of its class.

    Parameters and variables by their annotation, else variables by the name at the root of a construction or call; fields of
    classes and parameters with access modifiers as ``this.x``, and what methods assign to ``this.x``.
    """
    s = F.col("s")
    dotted = lambda c: F.regexp_replace(c, r" (?:\?)?\. ", ".")
    note = lambda prefix: F.array_join(F.slice("ts", _after(prefix) + 1, F.greatest(F.lit(0), F.coalesce(F.nullif(_after(prefix + r".*? (?==)"), F.lit(0)), F.size("ts")) - _after(prefix))), "")
    b = bound_names(script).select("path", "k", "name", "how")
    lead = rf"^(?:{_VAR})?(?:@{NAME} (?:\( )?)*(?:(?:{'|'.join(ACCESS)}) )*"
    no_require = ~s.rlike(" = require \\(")
    is_note, is_value = _has(" : ") & s.rlike(rf"{lead}{NAME} (?:[?!] )?: "), _has(" = ") & s.rlike(rf"{lead}{NAME} = {_ROOT}") & no_require
    heads = script.parts.where(is_note | is_value).select("path", "box", _at(rf"{lead}(?={NAME})").alias("k"), is_note.alias("noted"), F.when(is_note, F.regexp_replace(note(rf"{lead}{NAME} (?:[?!] )?: "), ";$", "")).otherwise(dotted(_first(rf"{lead}{NAME} = {_ROOT}"))).alias("raw"), _last_box().alias("last_box"))
    heads = materialise(heads.join(b, ["path", "k"]).withColumnRenamed("name", "var"), "typed-names")
    made = heads.where("NOT noted AND how <> 'parameter'").join(script.given, ["path", "last_box"], "left_anti")
    at_top = F.when(F.col("box") == -1, MODULE).otherwise(F.col("scope"))
    plain = scoped(script, heads.where("noted").unionByName(made).select("path", "box", "k", "var", "raw")).select("path", at_top.alias("scope"), "var", "raw", "k")
    classes = script.symbols.where("kind = 'class'").select("path", F.col("body").alias("box"), F.col("name").alias("scope"))
    key = rf"^{_MOD}(?={_KEY})"
    in_class = script.statements.where("box >= 0")
    noted, valued = in_class.where(_has(" : ") & s.rlike(rf"^{_MOD}{_KEY} (?:[?!] )?: ")), in_class.where(_has(" = ") & no_require & s.rlike(rf"^{_MOD}{_KEY} = {_ROOT}"))
    of_note = noted.select("path", "box", _at(key, "ts").alias("var"), F.regexp_replace(note(rf"^{_MOD}{_KEY} (?:[?!] )?: "), ";$", "").alias("raw"), _at(key).alias("k"))
    of_note = of_note.join(classes, ["path", "box"]).drop("box")
    of_value = valued.select("path", "box", _at(key, "ts").alias("var"), dotted(_first(rf"^{_MOD}{_KEY} = {_ROOT}")).alias("raw"), _at(key).alias("k"), _last_box().alias("last_box"))
    of_value = of_value.join(classes, ["path", "box"]).join(script.given, ["path", "last_box"], "left_anti").drop("box", "last_box")
    of_parameter = accessor_parameters(script).select("path", F.col("class").alias("scope"), F.col("field").alias("var"), F.col("type").alias("raw"), F.col("line").alias("k"))
    inside = script.symbols.where("parent IS NOT NULL").select("path", F.col("name").alias("scope"), "parent")
    assigned = script.statements.where(F.startswith("s", F.lit("this . ")) & s.rlike(rf"^this \. {_KEY} = {_ROOT}")).select("path", F.get("ks", F.lit(0)).alias("k"), F.get("ts", F.lit(2)).alias("var"), dotted(_first(rf"^this \. {_KEY} = {_ROOT}")).alias("raw"))
    assigned = scoped(script, assigned).join(inside, ["path", "scope"]).select("path", F.col("parent").alias("scope"), "var", "raw", "k")
    own = reduce(DataFrame.unionByName, [of_note, of_value, of_parameter, assigned]).withColumn("var", F.concat(F.lit("this."), "var"))
    # written, as a test of the type would else be planned into the reading of lines, with what makes the text in it many times over
    held = materialise(plain.unionByName(own), "declared-types")
    return held.select("path", "scope", "var", normalize_type(F.col("raw")).alias("type"), F.col("k").alias("ord")).where("type IS NOT NULL")
