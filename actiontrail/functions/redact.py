"""Secret redaction as one composed Column expression.

Each stage is a Java regular expression guarded by a cheap test, so a row
without secrets pays for a few scans and no rewriting. Patterns avoid
unbounded leading runs: text before a key is matched by a look-behind instead
of being captured, which keeps long token-less runs linear.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from actiontrail.functions.scalars import let

MASK = "[redacted]"
USERINFO_MASK = "***"

# Exact credential parameter names.
CREDENTIAL_KEYS = (
    "x-amz-signature", "x-amz-credential", "x-amz-security-token",
    "access_token", "refresh_token", "token", "sig", "signature", "api_key",
    "apikey", "api-key", "password", "passwd", "pwd", "client_secret",
    "client-secret", "client_assertion", "client-assertion", "auth", "secret",
)
# Self-describing token shapes.
TOKEN_SHAPES = (
    r"AKIA[0-9A-Z]{16}",
    r"gh[pousr]_[0-9A-Za-z]{36,}",
    r"xox[baprs]-[0-9A-Za-z-]{10,}",
    r"sk-[0-9A-Za-z_-]{20,}",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
)
# Words that make an assignment key look secret.
SECRET_WORDS = r"(?i:SECRET|TOKEN|PASSWORD|PASSWD|API[_-]?KEY|ACCESS[_-]?KEY|PRIVATE[_-]?KEY)"

# Output columns that may carry free text.
EVENT_TEXT_COLUMNS = ("command", "file_path", "url", "content_preview",
                      "mcp_server", "mcp_tool", "project_path", "approval_reason")

# --- URL userinfo ------------------------------------------------------------
_AUTH_STOP = r"/?#\"`<>\\{}|^\x00-\x20\x7f-\x{10ffff}"
_HOST_STOP = r",;&'()*+=" + _AUTH_STOP
_HOST_AHEAD = (r"(?=(?:\[[0-9A-Fa-f:.%]++\]|[^\[\]:@%" + _HOST_STOP + r"]++)"
               r"(?::[0-9]*+)?(?:[" + _HOST_STOP + r"]|\z))")
_HOST_PORT_LIST = (r"(?!(?:[^:@,;&" + _AUTH_STOP + r"]*+(?<=[^.]\.[^.]{1,63}|\.[^.]{0,63})"
                   r"|\[[0-9A-Fa-f:.]++\]):[0-9]++[,;&])")
_USERINFO = (r"(://(?<=[A-Za-z][A-Za-z0-9+.-]{0,64}://)" + _HOST_PORT_LIST +
             r"(?:[^:@" + _AUTH_STOP + r"]|@(?!" + _HOST_AHEAD + r"))*+:)"
             r"[^" + _AUTH_STOP + r"]+?@" + _HOST_AHEAD)


def mask_userinfo(c: Column) -> Column:
    return F.when(c.contains("://"),
                  F.regexp_replace(c, _USERINFO, "$1" + USERINFO_MASK + "@")).otherwise(c)


# --- Authorization headers ---------------------------------------------------
# The header's two names and the schemes whose credential is one token.
_HEADERS, _SCHEMES = "(?:proxy-)?authorization", "(?:basic|bearer)"
# The name stands by itself and may end a quoted or bracketed key; the scheme may open a quoted value.
_KEY_END, _PAD = r"""["']?]?""", r"[ \t]*"
_TOKEN68 = r"[\w.~+/-]+=*"
_AUTHORIZATION = r"(?i)(?<![\w-])(" + _HEADERS + _KEY_END + _PAD + "[:=]" + _PAD + r"""["']?""" + _SCHEMES + r"[ \t]+)" + _TOKEN68


def mask_authorization(c: Column) -> Column:
    return F.when(c.rlike("(?i)authorization"),
                  F.regexp_replace(c, _AUTHORIZATION, "$1" + MASK)).otherwise(c)


# --- exact credential keys ---------------------------------------------------
# A key counts when it stands between boundaries, after ignoring control and
# blank characters inside it. The encoded form also accepts each character as
# a percent escape, itself escaped any number of times.
_BOUND = r"?&;#\"'`<>\\,="
_NOISE = r"[\x00-\x20\x7f+]"
_VALUE = (r"(?:([ \t]*([\"'`])[\"'`<>\\]*+)[^&;#\"'`<>\\,\r\n]*+(?=\3)"
          r"|[\"'`<>\\]*+[^&;#\"'`<>\\,\r\n]*+)")
_GAP = r"[\x00-\x20\x7f]*+"
_PCT = r"%(?:" + _GAP + "2" + _GAP + "5)*+" + _GAP


def _plain_char(ch: str) -> str:
    return ch if ch.isalnum() or ch == "_" else "\\" + ch


def _hex_digit(d: str) -> str:
    return f"(?:{d}|{_PCT}3{d})" if d.isdigit() else d


def _escape_of(ch: str) -> str:
    hi, lo = f"{ord(ch):02x}"
    return _PCT + _hex_digit(hi) + _GAP + _hex_digit(lo)


def _encoded_char(ch: str) -> str:
    forms = [_plain_char(ch), _escape_of(ch)]
    if ch.isalpha():
        forms.append(_escape_of(ch.upper()))
    return "(?:" + "|".join(forms) + ")"


def _keys(char, noise: str) -> str:
    return "(?:" + "|".join(
        (noise + "*+").join(char(ch) for ch in key) for key in CREDENTIAL_KEYS) + ")"


_ENC_BOUND = (r"%(?:25){0,64}(?:26|3f|3b|23|22|27|60|3c|3e|5c|2c|3d)")
_ENC_NOISE = r"%(?:25){0,64}(?:0[0-9a-f]|1[0-9a-f]|20|2b|7f)"
_PLAIN_KEY = (r"(?i)((?<=\A|[" + _BOUND + r"]|" + _NOISE + r")" + _keys(_plain_char, _NOISE) +
              r"(?=" + _NOISE + r"|=)[^" + _BOUND + r"]*+=)" + _VALUE)
_ENC_ANY_NOISE = "(?:" + _NOISE + "|" + _ENC_NOISE + ")"
_EQUALS = "(?:=|" + _escape_of("=") + ")"
_ENCODED_KEY = (r"(?i)((?<=\A|[" + _BOUND + r"]|" + _NOISE + "|" + _ENC_BOUND + "|" + _ENC_NOISE +
                ")" + _keys(_encoded_char, _ENC_ANY_NOISE) +
                "(?=" + _ENC_ANY_NOISE + "|" + _EQUALS + ")" +
                "(?:(?!" + _EQUALS + "|" + _ENC_BOUND + ")[^" + _BOUND + "])*+" + _EQUALS + ")" + _VALUE)


def mask_credentials(c: Column) -> Column:
    repl = "$1$2" + MASK
    return (F.when(c.rlike(r"%[\x00-\x20\x7f]*[0-9A-Fa-f]"), F.regexp_replace(c, _ENCODED_KEY, repl))
            .when(c.contains("="), F.regexp_replace(c, _PLAIN_KEY, repl))
            .otherwise(c))


# --- secret-looking assignments outside URLs ---------------------------------
_URL_SPAN = r"https?://[^\s?\"'<>\\`]*(?:\?[^\"'<>\\`\r\n]*)?"
_KEY_TAIL = r"(" + SECRET_WORDS + r"[A-Za-z0-9_.\"'-]*\s*[:=]\s*"
_ASSIGN = (
    (_KEY_TAIL + r"\")[^\"]*(\")", "$1" + MASK + "$2"),
    (_KEY_TAIL + r"')[^']*(')", "$1" + MASK + "$2"),
    (_KEY_TAIL + r")[^\s,}\]\"']+", "$1" + MASK),
)


def _assignments(c: Column) -> Column:
    for pattern, repl in _ASSIGN:
        c = F.regexp_replace(c, pattern, repl)
    return c


def mask_assignments(c: Column) -> Column:
    outside = F.transform(F.split(c, _URL_SPAN), _assignments)
    spans = F.regexp_extract_all(c, F.lit(_URL_SPAN), F.lit(0))
    woven = F.array_join(F.zip_with(outside, spans, lambda o, u: F.concat(
        o, F.coalesce(u, F.lit("")))), "")
    return (F.when(~c.rlike(SECRET_WORDS), c)
            .when(c.rlike("https?://"), woven)
            .otherwise(_assignments(c)))


def mask_tokens(c: Column) -> Column:
    return F.regexp_replace(c, "|".join(TOKEN_SHAPES), r"\[redacted\]")


Stage = Callable[[Column], Column]
STAGES: tuple[Stage, ...] = (mask_userinfo, mask_authorization, mask_credentials, mask_assignments, mask_tokens)


def mask_shape(pattern: str, replacement: str) -> Stage:
    """A stage for one shape of secret that a run names itself."""
    return lambda c: F.regexp_replace(c, pattern, replacement)


def redact_text(c: Column | str) -> Column:
    """Mask credentials in one text column; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    for stage in STAGES:
        c = stage(c)
    return c


def _staged(df: DataFrame, columns: dict[str, Column], stages: tuple[Stage, ...]) -> DataFrame:
    """Apply the stages one projection at a time.

    Nesting five CASE expressions would repeat the inner text of each stage
    in every branch; a projection per stage keeps the plan linear in size.
    """
    df = df.withColumns(columns)
    for stage in stages:
        df = df.withColumns({name: stage(F.col(name)) for name in columns})
    return df


def redact_columns(df: DataFrame, columns: dict[str, str], stages: tuple[Stage, ...] = STAGES) -> DataFrame:
    """Add redacted copies: ``{target: source}``. Other `stages` only where a run says which secrets it means."""
    return _staged(df, {t: F.col(s) for t, s in columns.items()}, stages)


def redact_events(df: DataFrame) -> DataFrame:
    """Output-side redaction of the event columns that carry free text."""
    return redact_columns(df, {c: c for c in EVENT_TEXT_COLUMNS if c in df.columns})


# --- JSON documents ----------------------------------------------------------
# Keys that look secret but count tokens.
TOKEN_METRICS = (
    "audio_tokens", "cache_creation_input_tokens", "cache_read_input_tokens", "cache_write_input_tokens", "cached_input_tokens",
    "cached_tokens", "completion_tokens", "completion_tokens_details", "context_window_tokens", "ephemeral_1h_input_tokens",
    "ephemeral_5m_input_tokens", "input_token_count", "input_tokens", "input_tokens_details", "last_token_usage",
    "max_output_tokens", "max_tokens", "output_token_count", "output_tokens", "output_tokens_details", "prompt_tokens",
    "prompt_tokens_details", "reasoning_output_tokens", "reasoning_tokens", "time_to_first_token_ms", "token_count",
    "token_usage", "total_token_usage", "total_tokens",
)
_JSON_TOKEN = r"\"(?:[^\"\\]|\\.)*+\"|[{}\[\],:]|[^\s{}\[\],:\"]++"


def redact_json(doc: Column) -> Column:
    """A JSON document without secrets: values under secret-looking keys become the mask, whatever they hold, and other
    texts are redacted as such. Counters of tokens stay where they are numbers, or objects. Blanks between tokens go;
    null for what is not JSON, and for documents whose keys hold credentials."""
    tokens = F.regexp_extract_all(doc, F.lit(_JSON_TOKEN), F.lit(0))
    valid = F.try_parse_json(doc).isNotNull()
    return F.when(valid, let(tokens, _redacted_tokens))


# What some stage looks for; a text without any of it is left alone by all of them.
_SUSPECT = "|".join(("://", "[%=]", "(?i:authorization)", SECRET_WORDS, *TOKEN_SHAPES))


def _linear(c: Column) -> Column:
    """redact_text with each stage's text bound once, for texts that a stage could change."""
    out = c
    for stage in STAGES:
        out = let(out, stage)
    return F.when(c.rlike(_SUSPECT), out).otherwise(c)


def _redacted_tokens(tokens: Column) -> Column:
    at = lambda i: F.coalesce(F.get(tokens, i), F.lit(""))
    metric = lambda t: F.regexp_replace(F.lower(t), "[-.]", "_").isin(*[f'"{m}"' for m in TOKEN_METRICS])

    def told(token: Column, i: Column) -> Column:
        key = token.startswith('"') & (at(i + 1) == ":")
        number = at(i + 2).rlike(r"\A(?:-?[0-9].*|\{)\z")
        secret = key & token.rlike(SECRET_WORDS) & ~(metric(token) & number)
        text = F.when(token.startswith('"') & ~key, _linear(token)).otherwise(token)
        leaks = key & (_linear(token) != token)
        return F.struct(text.alias("text"), secret.alias("secret"), F.coalesce(leaks, F.lit(False)).alias("leaks"))

    def fold(state: Column, t: Column) -> Column:
        opens, closes = t["text"].isin("{", "["), t["text"].isin("}", "]")
        skip = state["skip"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        inside, masks = state["skip"] > 0, state["next"] & (t["text"] != ":")
        out = (F.when(inside, state["out"]).when(masks, F.array_append(state["out"], F.lit(f'"{MASK}"')))
               .otherwise(F.array_append(state["out"], t["text"])))
        return F.struct(out.alias("out"), F.when(inside | (masks & opens), skip).otherwise(0).cast("int").alias("skip"),
                        F.when(inside, F.lit(False)).when(t["text"] == ":", state["next"]).otherwise(t["secret"] & ~masks).alias("next"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("skip"), F.lit(False).alias("next"))
    known = F.transform(tokens, told)
    return let(known, lambda ts: F.when(~F.exists(ts, lambda t: t["leaks"]), F.array_join(F.aggregate(ts, start, fold)["out"], "")))
