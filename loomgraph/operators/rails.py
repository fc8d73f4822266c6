"""Ruby on Rails route files: a nesting-aware scan of statements, in columns, and what their declarations say.

A file's lines are stripped of comments and joined where one goes on in the next; the depth of blocks is a running sum of what
statements open and close. Only statements that stand directly in a top-level draw block are read, nested blocks are not entered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.text import lines

#: Verbs, constructs that are named but not expanded, and the patterns of receivers and targets.
VERBS = ("get", "post", "put", "patch", "delete")
CONSTRUCTS = (
    "collection", "concern", "concerns", "constraints", "controller", "defaults", "devise_for", "direct", "draw", "match", "member", "mount",
    "namespace", "nested", "resolve", "resource", "resources", "root", "scope", "shallow",
)
RECEIVER = r"^(Rails\.application\.routes|[A-Z][A-Za-z0-9_]*(::[A-Z][A-Za-z0-9_]*)*::Application\.routes)$"
TARGET = r"^[a-z][a-z0-9_]*(/[a-z][a-z0-9_]*)*#[a-z_][a-z0-9_]*$"
LIMITS = {"declarations": 5000, "path": 512, "target": 256}

_STRING = r""""(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'"""
_BLOCK = r"\bdo(\s*\|[^|]*\|)?$"


def _bare(code: Column) -> Column:
    """Code with its string literals emptied."""
    return F.regexp_replace(code, _STRING, "''")


def statements(files: DataFrame) -> DataFrame:
    """(path, line, code, depth, delta): statements of Ruby files (path, text), the block depth before each and how it changes.

    Comments, =begin blocks and what follows __END__ are left out. A line that ends in a comma, a backslash, an operator or an
    open bracket goes on in the next. Bodies of here-documents count as code.
    """
    by_line = Window.partitionBy("path").orderBy("line")
    so_far = by_line.rowsBetween(Window.unboundedPreceding, 0)
    d = lines(files)
    marks = F.when(F.col("content").rlike(r"^=begin\b"), 1).when(F.col("content").rlike(r"^=end\b"), -1).otherwise(0)
    d = d.withColumn("__in", F.sum(marks).over(so_far)).withColumn("__over", F.max(F.col("content") == "__END__").over(so_far))
    d = d.filter(~F.col("__over") & (F.col("__in") == 0) & ~F.col("content").rlike(r"^=end\b"))
    code = F.trim(F.regexp_replace("content", rf"^((?:[^\"'#]|{_STRING})*)#.*$", "$1"))
    d = d.select("path", "line", F.regexp_replace(code, r"\s+$", "").alias("code")).filter("code != ''")
    goes_on = _bare(F.col("code")).rlike(r"(,|\\|\(|\[|&&|\|\||[+.])$")
    d = d.withColumn("__new", F.when(F.coalesce(F.lag(goes_on).over(by_line), F.lit(False)), 0).otherwise(1)).withColumn("__s", F.sum("__new").over(so_far))
    part = F.struct("line", F.regexp_replace("code", r"\\$", "").alias("code"))
    d = d.groupBy("path", "__s").agg(F.sort_array(F.collect_list(part)).alias("__l"))
    d = d.select("path", F.col("__l")[0]["line"].alias("line"), F.array_join(F.transform("__l", lambda x: x["code"]), " ").alias("code"))
    bare = _bare(F.col("code"))
    keyword = bare.rlike(r"^(if|unless|case|while|until|for|begin|class|module|def)\b") & ~bare.rlike(r"\bend$")
    braces = F.regexp_count(bare, F.lit(r"\{")) - F.regexp_count(bare, F.lit(r"\}"))
    delta = F.when(bare.rlike(_BLOCK) | keyword, 1).otherwise(0) + braces - F.when(bare.rlike(r"^end\b"), 1).otherwise(0)
    d = d.withColumn("delta", delta)
    return d.select("path", "line", "code", (F.sum("delta").over(so_far) - F.col("delta")).alias("depth"), "delta")


def _literal(arg: Column, most: int, what: str) -> tuple[Column, Column]:
    """(value, error) of a plain string literal."""
    quoted = arg.rlike(rf"^({_STRING})$")
    body = F.regexp_replace(arg, r"^.|.$", "")
    error = (
        F.when(~arg.rlike(r"""^["']"""), f"non_literal_{what}")
        .when(arg.startswith('"') & arg.contains("#{"), "interpolated_literal")
        .when(~quoted | body.contains("\\") | (body == "") | (F.octet_length(body) > most), "malformed_literal")
    )
    return F.when(error.isNull(), body), error


def route_declarations(files: DataFrame) -> DataFrame:
    """(path, line, verb, route, target, construct): every statement of the files' draw blocks, in order.

    A supported route has verb, route and target (``controller#action``); all else has the ``construct`` that keeps it from being
    one: a named construct, conditional, other_statement, unrecognized_draw_receiver, declaration_limit, or the first of route_block,
    hash_rocket_target, extra_arguments, non_literal_path, interpolated_literal, malformed_literal, unsupported_option,
    missing_target, non_literal_target, malformed_target that holds. Draw blocks on one line have no statements.
    """
    by_line = Window.partitionBy("path").orderBy("line")
    s = statements(files)
    drawn = F.regexp_extract("code", r"^(.+?)\.draw\s*(?:do|\{)", 1)
    head = F.struct(drawn.alias("receiver"), (F.col("delta") == 1).alias("open"))
    s = s.withColumn("__head", F.last(F.when(F.col("depth") == 0, head), True).over(by_line.rowsBetween(Window.unboundedPreceding, 0)))
    known = F.col("__head.receiver").rlike(RECEIVER)
    top = (F.col("depth") == 0) & (F.col("__head.receiver") != "") & ~known
    inside = (F.col("depth") == 1) & known & F.col("__head.open") & ~F.col("code").rlike(r"^(end\b|\})")
    s = s.filter(top | inside).withColumn("__bare", _bare(F.col("code")))

    verb = F.regexp_extract("code", rf"^({'|'.join(VERBS)})(?=[\s(])", 1)
    given = F.regexp_replace(F.regexp_replace("code", r"^\w+\s*", ""), r"^\((.*)\)$", "$1")
    args = F.transform(F.regexp_extract_all(given, F.lit(rf"(?:[^,\"']|{_STRING})+"), F.lit(0)), lambda a: F.trim(a))
    s = s.withColumn("__args", args)
    key = lambda a: F.regexp_extract(a, r"^(\w+):(?!:)\s*", 1)
    pair = lambda a: (key(a) != "") | _bare(a).contains("=>")
    s = s.withColumn("__pos", F.filter("__args", lambda a: ~pair(a))).withColumn("__keys", F.transform(F.filter("__args", pair), key))
    option = lambda k: F.regexp_replace(F.get(F.filter("__args", lambda a: key(a) == k), F.lit(0)), r"^\w+:\s*", "")
    s = s.withColumn("__path", F.get("__pos", F.lit(0))).withColumn("__to", option("to")).withColumn("__as", option("as"))
    route, path_error = _literal(F.col("__path"), LIMITS["path"], "path")
    target, target_error = _literal(F.col("__to"), LIMITS["target"], "target")
    alias_error = _literal(F.col("__as"), LIMITS["path"], "alias")[1]
    odd_key = (F.size(F.array_except("__keys", F.array(F.lit("to"), F.lit("as")))) > 0) | (F.size(F.array_distinct("__keys")) < F.size("__keys"))
    why = (
        F.when(F.col("__bare").rlike(_BLOCK) | F.col("__bare").contains("{"), "route_block")
        .when(F.exists("__args", lambda a: _bare(a).contains("=>")), "hash_rocket_target")
        .when((F.size("__pos") != 1) | F.col("__path").rlike(r"^[*&]"), "extra_arguments")
        .when(path_error.isNotNull(), path_error)
        .when(odd_key | (F.col("__as").isNotNull() & ~F.col("__as").rlike(r"^:\w+[?!]?$") & alias_error.isNotNull()), "unsupported_option")
        .when(F.col("__to").isNull(), "missing_target")
        .when(target_error.isNotNull(), target_error)
        .when(~target.rlike(TARGET), "malformed_target")
    )
    word = F.regexp_extract("code", r"^([a-z_]+)(?![\w.:=])", 1)
    construct = (
        F.when(F.col("depth") == 0, "unrecognized_draw_receiver")
        .when(F.col("__bare").rlike(r"^(if|unless|case)\b|\s(if|unless)\s|\s\?\s"), "conditional")
        .when(verb != "", why)
        .when(word.isin(*CONSTRUCTS), word)
        .otherwise("other_statement")
    )
    s = s.withColumn("construct", construct).withColumn("__n", F.row_number().over(by_line)).filter(F.col("__n") <= LIMITS["declarations"] + 1)
    s = s.withColumn("construct", F.when(F.col("__n") > LIMITS["declarations"], "declaration_limit").otherwise(F.col("construct")))
    ok = F.col("construct").isNull()
    return s.select("path", "line", F.when(ok, verb).alias("verb"), F.when(ok, route).alias("route"), F.when(ok, target).alias("target"), "construct")


def route_targets(declared: DataFrame) -> DataFrame:
    """(route_id, controller, action) of supported routes: what :func:`loomgraph.operators.overlays.routes` links to methods."""
    at = F.concat_ws(":", "path", "line")
    return declared.filter("construct is null").select(at.alias("route_id"), F.substring_index("target", "#", 1).alias("controller"), F.substring_index("target", "#", -1).alias("action"))
