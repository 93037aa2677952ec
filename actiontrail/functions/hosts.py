"""Hosts, URLs, hashes and e-mail addresses: typing and canonical spelling."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from actiontrail.functions.scalars import let

INDICATOR = "struct<type:string,value:string>"
INDICATORS = f"array<{INDICATOR}>"

# The spellings that make an indicator unclickable in reports.
REFANG = (
    (r"hxxp|hXXp", "http"),
    (r"\[://\]", "://"),
    (r"\[\.\]|\(\.\)|\{\.\}|\[dot\]", "."),
    (r"\[:\]", ":"),
    (r"\[@\]|\(@\)", "@"),
)
_ANY_DEFANGED = r"hxxp|hXXp|\[(?:://|\.|dot|:|@)\]|\([.@]\)|\{\.\}"


def refang(c: Column) -> Column:
    out = c
    for pattern, plain in REFANG:
        out = F.regexp_replace(out, pattern, plain)
    return F.when(c.rlike(_ANY_DEFANGED), out).otherwise(c)


def pair(kind: Column | str, value: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("type"), value.alias("value"))


# --- IP addresses ------------------------------------------------------------
_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"\A{_OCTET}(\.{_OCTET}){{3}}\z"
# Loopback, private, link-local, multicast, unspecified.
IPV4_NOISE = (r"\A(127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.|"
              r"22[4-9]\.|23[0-9]\.|0\.0\.0\.0\z)")
_IPV6_SHAPE = (r"\A(?=[0-9a-f:.]*\z)(?:"
               r"(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}"
               r"|(?:[0-9a-f]{1,4}:){6}[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
               r"|(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,6})?::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,6})?"
               r"|(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,4})?::(?:[0-9a-f]{1,4}:){0,4}[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
               r")\z")


def _hextets(c: Column) -> Column:
    """Eight unpadded lower-case groups, or null when the text is not IPv6."""
    v4 = F.regexp_extract(c, r"([0-9]{1,3}(?:\.[0-9]{1,3}){3})\z", 1)
    octets = F.split(v4, r"\.")
    byte = lambda i: F.try_element_at(octets, F.lit(i)).try_cast("int")
    tail = F.concat(F.lower(F.hex(byte(1) * 256 + byte(2))), F.lit(":"),
                    F.lower(F.hex(byte(3) * 256 + byte(4))))
    whole = F.when(v4 == "", c).when(
        v4.rlike(IPV4), F.concat(F.regexp_replace(c, r"[0-9.]+\z", ""), tail))

    def groups(text: Column) -> Column:
        side = lambda i: F.filter(F.split(F.split_part(text, F.lit("::"), F.lit(i)), ":"),
                                  lambda g: g != "")
        left, right = side(1), side(2)
        gap = F.lit(8) - F.size(left) - F.size(right)
        filled = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0))), right)
        return F.transform(F.when(text.contains("::"), F.when(gap >= 1, filled))
                           .otherwise(F.split(text, ":")),
                           lambda g: F.regexp_replace(g, r"\A0+(?=.)", ""))

    return F.when(c.rlike(_IPV6_SHAPE), let(whole, groups))


def _compressed(groups: Column) -> Column:
    flat = F.array_join(groups, ":")
    out = flat
    for run in range(2, 9):  # the longest zero run wins, leftmost on ties
        zeros = r"(?:(?<=:)|\A)0(?::0){%d}(?:(?=:)|\z)" % (run - 1)
        out = F.when(flat.rlike(zeros),
                     F.regexp_replace(F.regexp_replace(
                         flat, r"(?s)\A(.*?)" + zeros + r"(.*)\z", "$1<>$2"),
                         r":?<>:?", "::")).otherwise(out)
    return out


def _classify_ipv6(host: Column) -> Column:
    def typed(g: Column) -> Column:
        first = F.conv(F.element_at(g, 1), 16, 10).cast("int")
        mapped = F.array_join(F.slice(g, 1, 6), ":") == "0:0:0:0:0:ffff"
        hi, lo = (F.conv(F.element_at(g, i), 16, 10).cast("int") for i in (7, 8))
        quad = F.concat_ws(".", *[x.cast("int").cast("string") for x in (
            F.floor(hi / 256), hi % 256, F.floor(lo / 256), lo % 256)])
        zeros7 = F.array_join(F.slice(g, 1, 7), ":") == "0:0:0:0:0:0:0"
        noise = ((zeros7 & F.element_at(g, 8).isin("0", "1"))
                 | first.between(0xFC00, 0xFDFF) | first.between(0xFE80, 0xFEBF)
                 | (first >= 0xFF00))
        return (F.when(mapped, F.when(~quad.rlike(IPV4_NOISE), pair("ipv4", quad)))
                .when(~noise, pair("ipv6", _compressed(g))))

    return let(_hextets(host), lambda g: F.when(g.isNotNull(), typed(g)))


# --- hosts -------------------------------------------------------------------
DOMAIN = (r"\A(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+"
          r"(?:xn--[a-z0-9-]{0,58}[a-z0-9]|[a-z]{2,63})\z")
LOCAL_NAME = r"(?:\A|\.)localhost\z|\.local\z"


def canonical_host(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"\.+\z", "")


def classify_host(c: Column) -> Column:
    """`struct(type, value)` for a host worth reporting, else null."""
    def typed(h: Column) -> Column:
        return (F.when(h.rlike(IPV4), F.when(~h.rlike(IPV4_NOISE), pair("ipv4", h)))
                .when(h.contains(":"), _classify_ipv6(h))
                .when(h.rlike(DOMAIN) & ~h.rlike(LOCAL_NAME), pair("domain", h)))

    return let(canonical_host(c), typed)


# --- URLs --------------------------------------------------------------------
URL_IN_TEXT = r"(?i:https?)://[^\s\"'<>`|;)\\]+"
_URL = (r"(?i)\A(https?)://(?:[A-Za-z0-9._:~!$&'()*+,;=%@-]*@)?"
        r"(\[[^\]/?#@]*\]|[^:@/?#\[\]]+)(?::([0-9]*))?(?=[/?#]|\z)([^?#]*)(\?[^#]*)?(#.*)?\z")


def canonical_url(c: Column) -> Column:
    """`struct(url, host)`: canonical text without userinfo or fragment, or null."""
    part = lambda u, i: F.regexp_extract(u, _URL, i)
    bad_escape = r"%(?![0-9A-Fa-f]{2})"

    def build(u: Column) -> Column:
        scheme, port = F.lower(part(u, 1)), part(u, 3)
        host = F.regexp_replace(F.lower(F.regexp_replace(part(u, 2), r"[\[\]]", "")),
                                r"\.+\z", "")
        shown = F.when(host.contains(":"), F.concat(F.lit("["), host, F.lit("]"))).otherwise(host)
        keep_port = (port != "") & ~(((scheme == "http") & (port == "80"))
                                     | ((scheme == "https") & (port == "443")))
        path = part(u, 4)
        # Characters a path may not carry raw are written as escapes.
        escaped = F.array_join(F.transform(F.split(path, ""), lambda ch: F.when(
            ch.rlike(r"[^\x21-\x7e]|[{}^]"), F.url_encode(ch)).otherwise(ch)), "")
        path = F.when(path.rlike(r"[^\x21-\x7e]|[{}^]"), escaped).otherwise(path)
        text = F.concat(scheme, F.lit("://"), shown,
                        F.when(keep_port, F.concat(F.lit(":"), port)).otherwise(F.lit("")),
                        path, part(u, 5))
        ok = (host != "") & ~part(u, 4).rlike(bad_escape) & ~part(u, 6).rlike(bad_escape)
        return F.when(ok, F.struct(text.alias("url"), host.alias("host")))

    return F.when(c.rlike(_URL) & ~c.rlike(r"[\x00-\x1f\x7f]"), build(c))


# Authorities of other schemes: the host is the list head, or what follows the
# first `@` that introduces a valid host, or the authority itself.
_STOP = r"/?#\"`<>\\{}|^\x00-\x20\x7f-\x{10ffff}"
_SEP = r",;&'()*+="
_HOST_PORT = r"(?:\[[0-9A-Fa-f:.]++\]|[^\[\]:@%" + _SEP + _STOP + r"]++)(?::[0-9]*+)?"
_AUTHORITY = (r"(?:(?=" + _HOST_PORT + r"[,;&])|[^" + _STOP + r"]*?@|)(" + _HOST_PORT +
              r")(?=[" + _SEP + _STOP + r"]|\z)")
_OTHER_SCHEME = (r"://(?<=[A-Za-z][A-Za-z0-9+.-]{0,64}://)"
                 r"(?<!(?:\A|[^A-Za-z0-9+.-])(?i:https?)://)" + _AUTHORITY)
_AUTHORITY_SPAN = (r"(?<![A-Za-z0-9+.-])[0-9+.-]*+[A-Za-z][A-Za-z0-9+.-]*+://" + _AUTHORITY)


def other_scheme_hosts(c: Column) -> Column:
    found = F.regexp_extract_all(c, F.lit(_OTHER_SCHEME), F.lit(1))
    return F.transform(found, lambda h: F.regexp_replace(h, r"\A\[|\](:[0-9]*)?\z|(?<=\A[^:]{1,255}):[0-9]*\z", ""))


def blank_urls(c: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(c, URL_IN_TEXT, " "), _AUTHORITY_SPAN, " ")
    return F.when(c.contains("://"), out).otherwise(c)


# --- hashes and e-mail -------------------------------------------------------
HASH_IN_TEXT = r"(?<![0-9A-Fa-f:-])[0-9A-Fa-f]{32,}+(?![0-9A-Fa-f:-])"
EMAIL_IN_TEXT = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
IPV4_IN_TEXT = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9.])"


def classify_hash(c: Column) -> Column:
    n = F.length(c)
    kind = F.when(n == 32, "md5").when(n == 40, "sha1").when(n == 64, "sha256")
    return F.when(kind.isNotNull(), pair(kind, F.lower(c)))


def classify_email(c: Column) -> Column:
    mail = F.lower(F.trim(c))
    domain = F.substring_index(mail, "@", -1)
    labels_ok = ~domain.rlike(r"(?:\A|\.)[0-9]+(?:\.|\z)")
    typed = canonical_host(domain)
    ok = (typed.rlike(DOMAIN) & ~typed.rlike(LOCAL_NAME) & ~typed.rlike(IPV4) & labels_ok
          & (F.instr(mail, "@") > 1))
    return F.when(ok, pair("email", mail))


# --- the field miner ---------------------------------------------------------
# No indicator can exist without one of these shapes.
CANDIDATE = r"://|@|[0-9]\.[0-9]|[0-9A-Fa-f]{32}"
_BOLD_URL = (r"(?<![*\\])\*\*(?=[\p{L}\p{N}])((?:(?!\*\*)[^\n`])*?(?i:https?)://"
             r"(?:(?!\*\*)[^\s\"'<>`|;)\\])*+)\*\*(?![^\s\"'<>`|;)\\])")


def strip_bold(c: Column) -> Column:
    """Drop a closing bold marker glued to a URL that a bold marker opened."""
    head = F.substring_index(c, "`", 1)
    rest = F.substring(c, F.length(head) + 1, F.length(c))
    return F.when(c.contains("**") & c.contains("://"),
                  F.concat(F.regexp_replace(head, _BOLD_URL, "**$1 "), rest)).otherwise(c)


def _typed(texts: Column, classify) -> Column:
    return F.filter(F.transform(texts, classify), lambda x: x.isNotNull())


def url_indicators(c: Column) -> Column:
    """Each reportable URL contributes itself and its host."""
    def both(raw: Column) -> Column:
        return let(canonical_url(raw), lambda u: F.when(u.isNotNull(), let(
            classify_host(u["host"]),
            lambda h: F.when(h.isNotNull(), F.array(pair("url", u["url"]), h)))))

    urls = F.regexp_extract_all(c, F.lit(URL_IN_TEXT), F.lit(0))
    mined = F.flatten(_typed(urls, both))
    others = _typed(other_scheme_hosts(c), classify_host)
    none = F.array().cast(INDICATORS)
    return F.when(c.contains("://"), F.concat(mined, others)).otherwise(none)


def bare_indicators(blanked: Column) -> Column:
    """IPv4, hash and e-mail tokens of a text whose URLs were blanked."""
    none = F.array().cast(INDICATORS)
    grab = lambda pattern: F.regexp_extract_all(blanked, F.lit(pattern), F.lit(0))
    return F.concat(
        F.when(blanked.rlike(r"[0-9]\.[0-9]"), _typed(grab(IPV4_IN_TEXT), lambda t: F.when(
            t.rlike(IPV4) & ~t.rlike(IPV4_NOISE), pair("ipv4", t)))).otherwise(none),
        F.when(blanked.rlike(r"[0-9A-Fa-f]{32}"), _typed(grab(HASH_IN_TEXT), classify_hash)).otherwise(none),
        F.when(blanked.contains("@"), _typed(grab(EMAIL_IN_TEXT), classify_email)).otherwise(none),
    )


def url_host(c: Column) -> Column:
    return canonical_url(c)["host"]


