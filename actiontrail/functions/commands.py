"""Command text to statements, natively, for the static POSIX subset.

A statement is one simple command. Two regular-expression passes do the work:
one cuts the text into statements at unquoted separators, one cuts a statement
into words and redirects. Operands are kept twice: as an array, and as one
string in which every operand stands between unit separators, so positional
predicates become ordinary regular expressions.

What stands outside the subset does not hide the rest: control words are taken
off the simple commands they lead, the bodies of closed here-documents are data,
and of a text with an unclosed quote the statements before it are kept.
`command_notes` says what was not read, and such a text is never static.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, functions as F

from actiontrail.functions.scalars import let

US = "\x1f"     # stands on both sides of every operand
INERT = "\x1e"  # precedes an operand whose leading ~, $ or % cannot expand

# Commands inside commands (`sh -c`, substitutions) are followed this many levels
# below the text itself; what lies deeper is noted.
MAX_DEPTH = 3
# Statement numbers of one nested source; a source with more only shares pipeline numbers.
_SOURCE_ROOM = 1 << 20

_SQ = r"'[^']*+'"
_INSIDE = r"[^()'\"]++|'[^']*+'|\"[^\"]*+\""
_PAREN = r"\([^()]*+\)"
for _ in range(MAX_DEPTH + 1):
    _PAREN = r"\((?:" + _INSIDE + "|" + _PAREN + r")*+\)"
_SUBST = r"\$" + _PAREN
_TICK = r"`[^`]*+`"
_DQ = r"\"(?:[^\"\\$`]++|\\.|" + _SUBST + "|" + _TICK + r"|\$)*+\""
_QUOTED = "|".join((_SQ, _DQ, r"\\.", _SUBST, _TICK))
_LEX = r"(?s)\A(?:" + _QUOTED + r"|[^'\"\\`])*+\z"
_COMMENT = r"(?s)((?:" + _QUOTED + r"|[^'\"\\`#]|(?<=[^\s;&|(])#)*+)(?:#[^\n]*+)?"
_STATEMENT = (r"(?s)((?:" + _QUOTED + r"|[<>]&|&>>?|>\||\\\n|[^;&|\n'\"\\`])++)"
              r"(\|\||&&|\|&|;;|;|\||&|\n|\z)")
_REDIRECT = r"[0-9]*(?:<<<|<<-?|<>|<&|>&|>>|>\||<|>)|&>>?"
_TOKEN = (r"(?s)" + _REDIRECT + r"|(?:" + _QUOTED + r"|[^\s<>'\"\\`&]|&(?!>))++")
_ASSIGNMENT = r"(?s)\A([A-Za-z_][A-Za-z0-9_]*)(\+?)=(.*)\z"
_READABLE = r"(?s)\A((?:" + _QUOTED + r"|[^'\"\\`])*+)"
# A closed here-document: its operator and word stay, its body goes.
_HERE_DOC = (r"(?s)((?:" + _QUOTED + r"|[^'\"\\`<]|<<<|<(?!<))++)|(<<-?)[ \t]*(['\"]?)([A-Za-z_]\w*)\3([^\n]*)"
             r"\n(?:.*?\n)??\t*\4[ \t]*(?=\n|\z)|(<)")
# Words of the shell grammar that stand before a command or alone.
_LEAD = (r"(?s)\A(?:\s|case\s+(?:" + _QUOTED + r"|[^\s;'\"\\`])++\s+in(?=\s)|(?:if|then|elif|else|while|until|do|time|!|\{)(?=\s)|\((?!\()|"
         r"(?:function\s+)?[A-Za-z_:][A-Za-z0-9_:]*\s*\(\)|[^\s()'\"$`;|&<>=]+\)(?=\s))++")
_ALONE = (r"(?s)\A\s*(?:(?:fi|done|esac)(?=[\s)}<>]|\z).*|(?:then|else|do|\{|\}|\)|;;)(?=[\s)}]|\z)[\s)}]*\z|(?:for|case|select|function)\s.*"
          r"|[\s){}]*\z)")
_CONTROL = r"(?s)\A\s*(?:if|then|elif|else|fi|for|while|until|do|done|case|esac|select|function|\{|\}|\(|\[\[)(?:\s|\z)|\A\s*\("

_CONTROL_ANYWHERE = (r"(?:\A|[;&|\n])\s*(?:(?:if|then|elif|else|fi|for|while|until|do|done|case|esac|select|function|\{|\}|\[\[)(?:\s|\z)"
                     r"|\(|[A-Za-z_:][A-Za-z0-9_:]*\s*\(\))")

# Launchers and the options they take before the real command.
_ASSIGN_WORD = r"[A-Za-z_][A-Za-z0-9_]*=[^\x1f]*"
_SUDO = (r"sudo(?:\x1f(?:-[CDghpRrTtu]|--(?:chdir|close-from|group|host|prompt|role|type|user))\x1f[^\x1f]*"
         r"|\x1f--(?:chdir|close-from|group|host|prompt|role|type|user|preserve-env)=[^\x1f]*"
         r"|\x1f-[CDghpRrTtu][^\x1f]+"
         r"|\x1f(?:-[BbEHnPAikNSs]+|--(?:background|bell|set-home|non-interactive|preserve-env|askpass|"
         r"login|no-update|reset-timestamp|shell|stdin))"
         r"|\x1f" + _ASSIGN_WORD + r")*(?:\x1f--)?")
_DOAS = r"doas(?:\x1f-[au]\x1f[^\x1f]*|\x1f-n)*(?:\x1f--)?"
_ENV = (r"env(?:\x1f(?:-[Cu]|--chdir|--unset)\x1f[^\x1f]*|\x1f--(?:chdir|unset)=[^\x1f]*"
        r"|\x1f(?:-|-[0i]+|--ignore-environment|--null))*(?:\x1f--)?(?:\x1f" + _ASSIGN_WORD + r")*")
_EXEC = r"exec(?:\x1f-a\x1f[^\x1f]*|\x1f-[cl]+)*(?:\x1f--)?"
_COMMAND = r"command(?:\x1f-p)*(?:\x1f--)?"
_NOHUP = r"nohup(?:\x1f--)?"
_LAUNCHER = (r"(?:[^\x1f]*/)?(?:" + "|".join((_SUDO, _DOAS, _ENV, _EXEC, _COMMAND, _NOHUP)) + r")")
_PREFIX = r"(?s)\A\x1f((?:" + _LAUNCHER + r"\x1f){1,4})(?=[^\x1f-])"
_LAUNCHER_NAMES = r"(?:\A|\x1f|/)(sudo|doas|env|exec|command|nohup)(?=\x1f)"

_SHELLS = r"\A(?:ba|z|da|k)?sh\z"
_INLINE = r"(?s)\A\x1f(?:-[a-bd-zA-Z]+\x1f)*-[a-zA-Z]*c\x1f([^\x1f]*)"
_SUBST_BODY = r"(?s)\$\(((?:" + _INSIDE + "|" + _PAREN + r")*+)\)|`([^`]*+)`"


def _plain(word: Column) -> Column:
    """Word text with its quoting removed; nothing is expanded."""
    open_ = F.regexp_replace(
        word, r"(?s)'([^']*+)'|\"((?:[^\"\\]++|\\.)*+)\"|\\\n|\\([^A-Za-z0-9])", "$1$2$3")
    # Inside double quotes a backslash only guards a quote, a backslash, `$` and a backtick.
    whole = F.regexp_replace(F.substring(word, F.lit(2), F.length(word) - 2), r"\\([\"\\$`])", "$1")
    return (F.when(word.rlike(r"(?s)\A\"(?:[^\"\\]++|\\.)*+\"\z"), whole)
            .when(word.rlike(r"['\"\\]"), open_).otherwise(word))


def _operand(word: Column) -> Column:
    inert = word.rlike(r"\A(?:'[~$%]|\"~|\\[~$%])")
    text = F.regexp_replace(_plain(word), "[\x1e\x1f]", " ")
    return F.when(inert, F.concat(F.lit(INERT), text)).otherwise(text)


def _redirect_op(op: Column) -> Column:
    kind = F.regexp_replace(op, r"\A[0-9]+", "")
    return (F.when(kind.isin(">", ">|", "&>"), "write").when(kind.isin(">>", "&>>"), "append")
            .when(kind == "<>", "read_write").when(kind == "<", "read")
            .when(kind.isin(">&", "<&"), "duplicate").otherwise("here_doc"))


def _redirect_fd(op: Column) -> Column:
    fd = F.regexp_extract(op, r"\A([0-9]{1,4})", 1)
    return (F.when(op.startswith("&"), -1).when(fd != "", fd.try_cast("int"))
            .when(op.rlike(r"\A<"), 0).otherwise(1))


def _build(raw: Column, ident: Column, pipeline: Column, parent: Column) -> Column:
    """One statement struct from its source text."""
    tokens = F.regexp_extract_all(raw, F.lit(_TOKEN), F.lit(0))
    is_op = lambda t: t.rlike(r"\A(?:" + _REDIRECT + r")\z")

    def from_tokens(toks: Column) -> Column:
        idx = F.sequence(F.lit(0), F.size(toks) - 1)
        at = lambda i: F.get(toks, i)
        words = F.when(F.size(toks) == 0, F.array().cast("array<string>")).otherwise(F.transform(
            F.filter(idx, lambda i: ~is_op(at(i)) & ((i == 0) | ~F.coalesce(is_op(at(i - 1)), F.lit(False)))),
            at))
        redirects = F.when(F.size(toks) == 0, F.array().cast(
            "array<struct<fd:int,op:string,target:string>>")).otherwise(F.transform(
                F.filter(idx, lambda i: is_op(at(i))),
                lambda i: F.struct(_redirect_fd(at(i)).cast("int").alias("fd"),
                                   F.when(at(i + 1) == "-", "close").otherwise(_redirect_op(at(i))).alias("op"),
                                   F.coalesce(_operand(at(i + 1)), F.lit("")).alias("target"))))
        return let(F.struct(words.alias("w"), redirects.alias("r")),
                   lambda x: from_words(x["w"], x["r"]))

    def from_words(words: Column, redirects: Column) -> Column:
        first = F.coalesce(F.get(F.filter(F.transform(
            words, lambda w, i: F.when(~w.rlike(_ASSIGNMENT), i)), lambda i: i.isNotNull()), F.lit(0)),
            F.size(words))
        assigned = F.transform(F.slice(words, 1, first), lambda w: F.struct(
            F.regexp_extract(w, _ASSIGNMENT, 1).alias("name"),
            _plain(F.regexp_extract(w, _ASSIGNMENT, 3)).alias("value"),
            (F.regexp_extract(w, _ASSIGNMENT, 2) == "+").alias("append")))
        rest = F.slice(words, first + 1, F.greatest(F.size(words) - first, F.lit(0)))
        joined = F.concat(F.lit(US), F.array_join(F.transform(rest, _operand), US), F.lit(US))
        return let(F.struct(joined.alias("j"), F.regexp_extract(joined, _PREFIX, 1).alias("p"),
                            assigned.alias("a")),
                   lambda x: assemble(x["j"], x["p"], x["a"], redirects))

    def assemble(joined: Column, prefix: Column, assigned: Column, redirects: Column) -> Column:
        body = F.substring(joined, F.length(prefix) + 2, F.length(joined))
        exe = F.substring_index(body, US, 1)
        args = F.substring(body, F.length(exe) + 1, F.length(body))
        base = F.regexp_replace(F.lower(exe), r"(?s)\A.*[/\\]", "")
        return F.struct(
            ident.cast("bigint").alias("statement_id"), pipeline.cast("bigint").alias("pipeline_id"),
            parent.cast("bigint").alias("parent_statement_id"),
            F.regexp_replace(base, r"\.(exe|cmd|bat|com|ps1)\z", "").alias("name"),
            exe.alias("executable"), args.alias("args"),
            F.concat(F.lit(US), F.regexp_replace(base, r"\.(exe|cmd|bat|com|ps1)\z", ""), args).alias("line"),
            F.filter(F.split(args, US), lambda t: t != "").alias("operands"),
            redirects.alias("redirects"), assigned.alias("assignments"),
            F.when(prefix == "", F.array().cast("array<string>")).otherwise(
                F.regexp_extract_all(prefix, F.lit(_LAUNCHER_NAMES), F.lit(1))).alias("wrappers"),
            F.concat(F.lit(US), prefix).alias("wrapper_args"), raw.alias("source"))

    return let(tokens, from_tokens)


def _body(piece: Column) -> Column:
    """The simple command of a piece of text: without leading control words and surplus closing brackets."""
    bare = F.trim(F.regexp_replace(piece, _LEAD, ""))
    opened = F.length(F.regexp_replace(bare, r"[^(]", "")) < F.length(F.regexp_replace(bare, r"[^)]", ""))
    led = piece.rlike(_CONTROL) | opened | piece.rlike(r"\A\s*(?:!|time\s|[A-Za-z_:][A-Za-z0-9_:]*\s*\(\)|[^\s()'\"$`;|&<>=]+\)\s)")
    closed = F.when(opened, F.regexp_replace(bare, r"\)+\s*\z", "")).otherwise(bare)
    return F.when(~led, F.trim(piece)).when(bare.rlike(_ALONE), "").otherwise(closed)


def _parse(text: Column, base: Column, parent: Column) -> Column:
    """Statements of one source text, numbered upward from `base`."""
    plain = F.when(text.contains("<<"), F.regexp_replace(text, _HERE_DOC, "$1$2$4$5$6")).otherwise(text)
    clean = F.when(text.contains("#"), F.regexp_replace(plain, _COMMENT, "$1")).otherwise(plain)
    readable = F.when(clean.rlike(_LEX), clean).otherwise(F.concat(F.regexp_extract(clean, _READABLE, 1), F.lit("\x00")))

    def cut(src: Column) -> Column:
        parts = F.arrays_zip(
            F.regexp_extract_all(src, F.lit(_STATEMENT), F.lit(1)).alias("raw"),
            F.regexp_extract_all(src, F.lit(_STATEMENT), F.lit(2)).alias("sep"))
        named = F.transform(F.filter(parts, lambda p: ~p["raw"].contains("\x00")),
                            lambda p: F.struct(_body(p["raw"]).alias("raw"), p["sep"].alias("sep")))
        return let(F.filter(named, lambda p: p["raw"] != ""), number)

    def number(parts: Column) -> Column:
        piped = lambda p: F.coalesce(p["sep"].isin("|", "|&"), F.lit(False))

        def one(p: Column, i: Column) -> Column:
            earlier = F.slice(parts, 1, i)
            group = F.size(F.filter(earlier, lambda q: ~piped(q))) + 1
            joined = piped(p) | piped(F.get(parts, i - 1))
            pipeline = F.when((i > 0) & joined | piped(p), base + group).otherwise(F.lit(0))
            return _build(p["raw"], base + i + 1, pipeline, parent)

        return F.transform(parts, one)

    return let(readable, cut)


def _nested_sources(st: Column) -> Column:
    subs = F.concat(F.regexp_extract_all(st["source"], F.lit(_SUBST_BODY), F.lit(1)),
                    F.regexp_extract_all(st["source"], F.lit(_SUBST_BODY), F.lit(2)))
    unquoted = F.regexp_replace(st["source"], _SQ, "")
    active = F.when(unquoted.rlike(r"\$\(|`"), subs).otherwise(F.array().cast("array<string>"))
    script = F.when(st["name"].rlike(_SHELLS), F.array(F.regexp_extract(st["args"], _INLINE, 1))).otherwise(
        F.array().cast("array<string>"))
    return F.filter(F.concat(active, script), lambda s: F.trim(s) != "")


def _expand(statements: Column, first: Column) -> Column:
    """Statements nested one level inside `statements`, numbered upward from `first`."""
    found = F.flatten(F.transform(statements, lambda st: F.flatten(F.transform(
        _nested_sources(st),
        lambda src, j: _parse(src, (st["statement_id"] * 1024 + j) * _SOURCE_ROOM, st["statement_id"])))))
    return F.transform(found, lambda st, i: st.withField("statement_id", (first + i + 1).cast("bigint")))


def notes(text: Column, statements: Column, deeper: Column) -> Column:
    """What of the text was not read as simple commands; empty where everything was."""
    here_doc = F.exists(statements, lambda s: F.exists(s["redirects"], lambda r: r["op"] == "here_doc"))
    bare = F.regexp_replace(text, r"(?s)\\\\.|" + _SQ + "|" + _DQ, "")
    control = bare.rlike(_CONTROL_ANYWHERE)
    found = {"unclosed quote": ~text.rlike(_LEX), "here-document": here_doc, "control flow": control,
             "nested too deep": deeper, "no command": F.size(statements) == 0}
    return F.array_compact(F.array(*[F.when(F.coalesce(hit, F.lit(False)), F.lit(name)) for name, hit in found.items()]))


def static_subset(statements: Column) -> Column:
    """One simple command or one pipeline with nothing left to run time."""
    dynamic = F.exists(statements, lambda s: F.regexp_replace(s["source"], _SQ, "").rlike(r"[$`]")
                       | (s["parent_statement_id"] > 0) | s["name"].isin("eval", "source", ".")
                       | s["wrapper_args"].rlike(r"\x1f(?:-[A-Za-z]*[AikNSs][A-Za-z]*|--(?:askpass|login|"
                                                 r"no-update|reset-timestamp|shell|stdin))(?=\x1f)"))
    one = (F.size(statements) == 1) | F.forall(
        statements, lambda s: (s["pipeline_id"] > 0)
        & (s["pipeline_id"] == F.get(statements, F.lit(0))["pipeline_id"]))
    return one & ~dynamic


def command_columns(df: DataFrame, text: str = "command", only: Column | None = None) -> DataFrame:
    """Add `commands`, `command_notes`, `analysable` and `command_static` for a command text.

    `only` restricts the work to the rows command predicates look at. `analysable`: nothing was left unread.
    """
    wanted = F.col(text).isNotNull() if only is None else (only & F.col(text).isNotNull())
    x = _expressions(text, df.sparkSession.sparkContext.applicationId)
    df = df.withColumn("_l0", F.when(wanted, x["top"]))
    for k in range(1, MAX_DEPTH + 1):
        df = df.withColumn(f"_l{k}", F.coalesce(F.when(x[f"deep{k}"], x[f"level{k}"]), F.slice("_l0", 1, 0)))
    df = df.withColumn("commands", F.concat(*[f"_l{k}" for k in range(MAX_DEPTH + 1)]))
    df = df.withColumn("command_notes", F.when(F.col("commands").isNotNull(), x["notes"]))
    df = df.withColumn("analysable", F.coalesce(F.size("command_notes") == 0, F.lit(False)))
    return (df.withColumn("command_static", F.coalesce(F.col("analysable") & x["static"], F.lit(False)))
            .drop(*[f"_l{k}" for k in range(MAX_DEPTH + 1)]))


@lru_cache(maxsize=16)
def _expressions(text: str, application: str) -> dict[str, Column]:
    """The parser's columns, built once per application: they depend on column
    names only, and describing them to the JVM takes seconds."""
    nested = r"\$\(|`|sh[\"']?\s.*-[a-zA-Z]*c"
    out = {"top": _parse(F.col(text), F.lit(0), F.lit(0)), "static": static_subset(F.col("commands"))}
    before = F.lit(0)
    for k in range(1, MAX_DEPTH + 2):
        above = F.col(f"_l{k - 1}")
        out[f"deep{k}"] = F.col(text).rlike(nested) & F.exists(above, lambda s: s["source"].rlike(r"(?s)" + nested))
        before = before + F.size(above)
        if k <= MAX_DEPTH:
            out[f"level{k}"] = _expand(above, before)
    deeper = F.exists(F.col(f"_l{MAX_DEPTH}"), lambda s: F.size(_nested_sources(s)) > 0)
    out["notes"] = notes(F.col(text), F.col("commands"), deeper)
    return out


def pipeline_pairs(commands: Column) -> Column:
    """(upstream, downstream) names of statements that feed later ones of their pipeline."""
    return F.flatten(F.transform(commands, lambda a: F.transform(
        F.filter(commands, lambda b: (a["pipeline_id"] > 0) & (b["pipeline_id"] == a["pipeline_id"])
                 & (b["statement_id"] > a["statement_id"])),
        lambda b: F.struct(a["name"].alias("upstream"), b["name"].alias("downstream")))))


def nested_pairs(commands: Column) -> Column:
    """(outer_name, inner_name) of statements and those written inside them."""
    return F.flatten(F.transform(commands, lambda a: F.transform(
        F.filter(commands, lambda b: b["parent_statement_id"] == a["statement_id"]),
        lambda b: F.struct(a["name"].alias("outer_name"), b["name"].alias("inner_name")))))


def statements(df: DataFrame, key: str = "event_id") -> DataFrame:
    """The table form: one row per statement."""
    return (df.select(key, F.explode_outer("commands").alias("c"))
            .where(F.col("c").isNotNull()).select(key, "c.*"))
