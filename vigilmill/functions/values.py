"""Addresses, accounts, paths and ids of a text as canonical keys, and keys taken apart: native columns.

A text is cut into tokens at blanks, quotes and brackets; a token is of the first kind whose form it has as a whole.  So the work
is linear in the text, and a value inside a longer one is not found twice.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# First-party sites that any text mentions, platforms that rent out names under their own; second-level labels of country
# registries; top-level domains that are read as such (others: two letters, xn--); those that are file endings or words of code as well.
FIRST_PARTIES = ("github.com", "gitlab.com", "google.com", "wikipedia.org", "youtube.com", "microsoft.com", "stackoverflow.com", "python.org", "npmjs.com")
TENANT_SUFFIXES = ("github.io", "gitlab.io", "pages.dev", "workers.dev", "vercel.app", "netlify.app", "herokuapp.com", "web.app", "firebaseapp.com", "ngrok.io", "blogspot.com", "azurewebsites.net", "cloudfront.net", "onrender.com")
REGISTRY_LABELS = ("co", "com", "org", "net", "gov", "ac", "edu", "ne", "or", "go")
TOP_LEVEL = (
    "com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "io", "dev", "app", "cloud", "example", "test", "online", "site", "shop", "xyz", "tech", "arpa", "pro", "name", "museum", "aero", "coop", "jobs",
    "mobi", "travel", "tel", "asia", "cat", "post", "icu", "buzz", "cyou", "fun", "club", "vip", "work", "top", "zone", "digital", "store", "click", "live", "space", "link", "network", "email", "page", "web", "wiki",
    "blog", "news", "media", "agency", "academy", "bank", "berlin", "bike", "bio", "business", "cafe", "care", "center", "chat", "city", "codes", "company", "computer", "cool", "credit", "date", "design", "direct",
    "domains", "download", "education", "energy", "events", "exchange", "expert", "express", "finance", "fit", "fund", "games", "gallery", "global", "group", "guru", "help", "host", "hosting", "house", "ink", "kim",
    "land", "law", "legal", "life", "limited", "loan", "love", "ltd", "market", "marketing", "mobile", "money", "ninja", "one", "party", "photo", "pics", "plus", "press", "pub", "red", "rest", "review", "rocks",
    "run", "sale", "school", "science", "security", "services", "social", "software", "solar", "solutions", "stream", "studio", "support", "systems", "team", "technology", "tips", "tools", "trade", "university",
    "video", "website", "win", "world", "wtf", "yoga", "zip", "data", "new", "local", "internal", "invalid", "localhost",
)
FILE_ENDINGS = ("py", "sh", "rs", "md", "pl", "ps", "so", "cc", "app", "zip", "mov", "name", "data", "run", "host", "one", "new", "red", "stream", "pub", "pm", "cr", "id", "page", "plus", "date", "link", "help", "test", "local")
SCHEMES = ("http", "https", "ws", "wss")

LABEL = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_-]{0,61}[\p{L}\p{N}_])?"
#: Repeated groups give nothing back (`++`): none could, and Java goes a call deeper with each round of one that might, which ends the executor on a long token.
_HOST = rf"(?:{LABEL}\.)++\p{{L}}[\p{{L}}\p{{N}}-]{{1,62}}"
IPV4 = r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"
DATE = r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|(?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01]))"
_CUT = r"[\s\"'`<>()\[\]{}|,;]+"
#: Full forms by kind, tried in this order on lower-case tokens.
FORMS = (
    ("date", rf"^{DATE}(?:t[0-9:.z+-]*)?$"),
    ("url", r"^[a-z][a-z0-9+.-]{1,15}://[^/?#@]*@?[^/?#\s]+.*$"),
    ("email", rf"^(?:mailto:)?[a-z0-9._%+-]{{1,64}}@(?:{_HOST}|{IPV4})$"),
    ("host", rf"^{IPV4}(?::[0-9]{{1,5}})?$"),
    ("iban", r"^[a-z]{2}[0-9]{2}[a-z0-9]{10,30}$"),
    ("number", r"^\+?[0-9](?:[0-9.-]*[0-9])?$"),
    ("host", rf"^(?:www\.)?{_HOST}(?::[0-9]{{2,5}})?$"),
    ("url", rf"^(?:{_HOST})(?::[0-9]{{2,5}})?/[^\s]*$"),
    ("path", r"^(?:~|\$home|\.{1,2}|[a-z]:|file:/*)?(?:[/\\][^/\\\s]++)++[/\\]?$"),
    ("path", r"^[\w.-]+(?:[/\\][\w.-]++)++[/\\]?$"),
    ("id", r"^[a-z0-9]+(?:[-_]++[a-z0-9]++)*+$"),
)
VALUE = "struct<kind:string,key:string>"


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def defanged(text: Column) -> Column:
    """Addresses written to dodge filters, written out: hxxp, [.] (dot) {at} and the like, blanks around @ and dots in brackets."""
    for pattern, plain in (
        (r"(?i)\bhxxp(s?)\b", "http$1"), (r"(?i)\bfxp(s?)\b", "ftp$1"), (r"\s*[\[({<]\s*:\s*(?://)?\s*[\])}>]\s*", "://"), (r"(?i)\s*[\[({<]\s*(?:\.|dot)\s*[\])}>]\s*", "."),
        (r"(?i)\s*[\[({<]\s*(?:@|at)\s*[\])}>]\s*", "@"), (r"(?i)(\w@[\w-]+)\s+dot\s+([a-z]{2,})\b", "$1.$2"), (r"(?i)\b([\w.+-]{1,64})\s+at\s+([\w-]+)\s+dot\s+([a-z]{2,})\b", "$1@$2.$3"), (r"(\w)\s@\s(\w)", "$1@$2"),
    ):
        text = F.regexp_replace(text, pattern, plain)
    return text


def dotted(host: Column) -> Column:
    """An IPv4 address written as one number, in decimal or hexadecimal, as four; other hosts as they are."""
    number = F.when(host.rlike("^0x[0-9a-f]{1,8}$"), F.conv(F.substring(host, 3, 8), 16, 10).cast("bigint")).when(host.rlike("^[0-9]{8,10}$"), host.cast("bigint"))
    part = lambda n: F.shiftright(number, n).bitwiseAND(F.lit(255)).cast("string")
    return F.when(number < (1 << 32), F.concat_ws(".", part(24), part(16), part(8), part(0))).otherwise(host)


def ipv6_key(address: Column) -> Column:
    """An IPv6 address in its shortest form: groups without leading zeros, the longest run of zeros (two or more) as `::`; null for what is none."""

    def spread(t: Column) -> Column:
        halves = F.split(t, "::", 2)
        groups = lambda h: F.filter(F.split(h, ":"), lambda g: g != "")
        left, right = groups(F.get(halves, F.lit(0))), groups(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
        missing = F.greatest(F.lit(0), 8 - F.size(left) - F.size(right))
        every = F.when(t.contains("::"), F.concat(left, F.array_repeat(F.lit("0"), missing), right)).otherwise(left)
        plain = F.array_join(F.transform(every, lambda g: F.regexp_replace(g, "^0+(?=.)", "")), ":")
        good = t.rlike(r"^[0-9a-f:]{2,39}$") & ~t.rlike(":::|::.*::|^:[^:]|[^:]:$") & (F.size(every) == 8) & (~t.contains("::") | (missing > 0)) & F.forall(every, lambda g: F.length(g) <= 4)
        runs = [(rf"(?:^|:)0(?::0){{{n - 1}}}(?::|$)", n) for n in range(8, 1, -1)]
        short = F.coalesce(*[F.when(plain.rlike(form), F.regexp_replace(F.regexp_replace(plain, f"^(.*?){form}", "$1\x01"), "\x01", "::")) for form, _ in runs], plain)
        return F.when(good, short)

    return _let(F.lower(address), spread)


def host_key(host: Column) -> Column:
    """Lower case, without user, port and dots around; ideographic full stops as dots; an IPv6 address in brackets in its shortest form."""

    def key(h: Column) -> Column:
        six = F.regexp_extract(h, r"^\[([0-9a-f:.]+)\]", 1)
        return F.when(six != "", F.coalesce(F.concat(F.lit("["), ipv6_key(six), F.lit("]")), h)).otherwise(dotted(F.trim(F.regexp_replace(h, r":[0-9]*$", ""), F.lit("."))))

    return _let(F.regexp_replace(F.translate(F.lower(host), "。．｡", "..."), "^.*@", ""), key)


def path_segments(path: Column) -> Column:
    """Segments with `.` and empty ones dropped and `..` applied (at the root it is dropped)."""
    parts = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    return F.aggregate(parts, F.array().cast("array<string>"), lambda a, s: F.when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, s)))


def url_key(url: Column) -> Column:
    """scheme://host/path?query: web schemes as https, path decoded and resolved, no fragment, port, user or slash at the end."""

    def parts(u: Column) -> Column:
        path = F.regexp_extract(u, r"^[^:]+://[^/?]*([^?]*)", 1)
        plain = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2b"))), path)
        return F.struct(
            F.regexp_extract(u, "^([a-z][a-z0-9+.-]*)://", 1).alias("scheme"), host_key(F.regexp_extract(u, "^[^:]+://([^/?]*)", 1)).alias("host"),
            path_segments(plain).alias("steps"), F.regexp_extract(u, r"(\?.+)$", 1).alias("query"),
        )

    def key(p: Column) -> Column:
        path = F.when(F.size(p["steps"]) > 0, F.concat(F.lit("/"), F.array_join(p["steps"], "/"))).otherwise("")
        return F.when(p["host"] != "", F.concat(F.when(p["scheme"].isin(*SCHEMES), "https").otherwise(p["scheme"]), F.lit("://"), p["host"], path, p["query"]))

    low = F.regexp_replace(F.lower(F.trim(url)), "#.*$", "")
    whole = lambda u: F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).when(~u.rlike("^[a-z][a-z0-9+.-]*://"), F.concat(F.lit("https://"), u)).otherwise(u)
    return _let(_let(_let(low, whole), parts), key)


def path_key(path: Column) -> Column:
    """Lower case, forward slashes, no drive or file:, `~` for any home folder; a relative path keeps the `..` it starts with."""
    p = F.replace(F.lower(path), F.lit("\\"), F.lit("/"))
    p = F.regexp_replace(F.regexp_replace(p, "^file:/*", "/"), "^/?[a-z]:(?=/)", "")
    p = F.regexp_replace(F.regexp_replace(p, r"^(?:\$home|\$\{home\})(?=/|$)", "~"), "^(?:/(?:users|home)/[^/]+|/root)(?=/|$)", "~")
    up = F.regexp_extract(p, r"^((?:\.\./)+)", 1)
    start = F.when(p.startswith("/"), "/").otherwise(up)
    return F.concat(start, F.array_join(path_segments(F.substr(p, F.length(up) + 1)), "/"))


def email_key(email: Column) -> Column:
    """Lower case, without mailto: and what follows a plus."""
    low = F.regexp_replace(F.lower(email), "^mailto:", "")
    local = F.regexp_extract(low, r"^([^+@]+)", 1)
    return F.concat(F.when(local != "", local).otherwise(F.regexp_extract(low, "^([^@]*)", 1)), F.lit("@"), host_key(F.regexp_extract(low, "@([^@]*)$", 1)))


def real_host(host: Column) -> Column:
    """An address, or a name under a top-level domain; one that is a file ending too needs a label before the name, and a registry's label is no site."""
    last = F.element_at(F.split(host, r"\."), -1)
    labels = F.size(F.split(host, r"\."))
    known = last.isin(*TOP_LEVEL) | last.rlike("^[a-z]{2}$") | last.startswith("xn--")
    registry = (labels == 2) & last.rlike("^[a-z]{2}$") & F.split_part(host, F.lit("."), F.lit(1)).isin(*REGISTRY_LABELS)
    return host.rlike(rf"^(?:{IPV4}|\[[0-9a-f:.]+\])$") | (known & (~last.isin(*FILE_ENDINGS) | (labels >= 3)) & ~registry)


def iban_valid(compact: Column) -> Column:
    """Checksum modulo 97 of a compact lower-case form."""
    turned = F.upper(F.concat(F.substr(compact, F.lit(5)), F.left(compact, F.lit(4))))
    codes = F.transform(F.split(turned, ""), lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    return F.aggregate(codes, F.lit(0), lambda a, d: F.when(d < 10, (a * 10 + d) % 97).otherwise((a * 100 + d) % 97).cast("int")) == 1


def _typed(token: Column) -> Column:
    """struct<kind, key> of a token, key null for one that says nothing: dates, short numbers, words."""
    low = F.lower(token)
    kind = F.lit("word")
    for name, form in reversed(FORMS):
        kind = F.when(low.rlike(form), F.lit(name)).otherwise(kind)

    def keyed(t: Column) -> Column:
        kind, raw = t["kind"], t["raw"]
        as_url = lambda u: F.when(~u.rlike("^(?:hxxp|fxp)") & (real_host(F.regexp_extract(u, "://([^/?]*)", 1)) | raw.contains("://")), u)
        as_host = lambda h: F.when(real_host(h), h)
        as_number = lambda d: F.when(F.length(d) >= 9, d)
        as_path = lambda p: F.when((F.length(raw) >= 6) & p.rlike("[^a-z/]|/.*/.*/|^/|^~"), p)
        key = (
            F.when((kind == "url") & F.lower(raw).startswith("file:"), path_key(raw)).when(kind == "url", _let(url_key(raw), as_url)).when(kind == "email", email_key(raw))
            .when(kind == "host", _let(host_key(raw), as_host)).when(kind == "iban", F.lower(raw)).when(kind == "number", _let(F.regexp_replace(raw, "[^0-9]", ""), as_number))
            .when(kind == "path", _let(path_key(raw), as_path)).when((kind == "id") & (F.length(raw) >= 8) & low_id(raw), F.lower(raw))
        )
        named = F.when(kind == "iban", F.when(iban_valid(F.lower(raw)) | (raw == F.upper(raw)), "iban").otherwise("id")).otherwise(kind)
        return F.struct(named.alias("kind"), key.alias("key"))

    return _let(F.struct(kind.alias("kind"), token.alias("raw")), keyed)


def low_id(raw: Column) -> Column:
    return F.lower(raw).rlike("[a-z]") & raw.rlike("[0-9]")


# A number, card or phone in groups; an IPv6 address, bare or in brackets; a URL to one.
_GROUPED = r"(?<![\w.\-/+])\+?[0-9](?:(?=[ -]?[0-9])[0-9 -]){7,}(?![\w/]|-[0-9a-zA-Z])"
_SIX = r"\[[0-9a-fA-F:.]{2,45}\]"
_SIX_URL = rf"[a-zA-Z][a-zA-Z0-9+.-]{{1,15}}://{_SIX}(?::[0-9]{{1,5}})?[^\s\"'<>)]*"
_SIX_BARE = r"(?<![\w:.\-/%@\[])(?=[0-9a-fA-F.]*:[0-9a-fA-F.]*:)[0-9a-fA-F:.]{5,45}(?![\w:.\-/%\]])"


def values(text: Column) -> Column:
    """array<struct<kind, key>>: the distinctive values of a text, raw and defanged, each key once."""
    dodged = F.when(text.rlike(r"(?i)hxxp|fxp|[\[({<]\s*(?:\.|dot|at|@|:)|\sdot\s|\w\s@\s\w"), defanged(text))
    return _let(F.concat_ws("\n", text, dodged), _values)


_IBAN = r"\b([A-Z]{2}[0-9]{2})((?: [A-Z0-9]{4}){2,7})((?: [A-Z0-9]{1,3})?)\b"


def _values(seen: Column) -> Column:
    # An IBAN in groups is one token, and out of the way of numbers in groups; then addresses with colons, which are cut apart otherwise.
    ibans = F.transform(F.regexp_extract_all(seen, F.lit(_IBAN), F.lit(0)), lambda g: F.replace(g, F.lit(" "), F.lit("")))
    six = seen.rlike(r"[0-9a-fA-F]?:[0-9a-fA-F]{0,4}:[0-9a-fA-F]")
    first = F.struct(ibans.alias("ibans"), F.when(F.size(ibans) > 0, F.regexp_replace(seen, _IBAN, "\n")).otherwise(seen).alias("bare"), six.alias("six"))
    plain = lambda x: F.struct(x["ibans"].alias("ibans"), x["bare"].alias("bare"), F.array().cast(f"array<{VALUE}>").alias("found"))
    return _let(_let(first, lambda x: F.when(x["six"], _sixes(x)).otherwise(plain(x))), _tokens)


def _sixes(x: Column) -> Column:
    """IPv6 addresses and URLs to them, and the text without them."""
    named = lambda kind, keys: F.transform(F.filter(keys, lambda k: k.isNotNull()), lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))
    urls = F.transform(F.regexp_extract_all(x["bare"], F.lit(_SIX_URL), F.lit(0)), lambda u: url_key(F.regexp_replace(u, r"[,.;:!?]+$", "")))

    def rest(left: Column) -> Column:
        hosts = F.concat(F.regexp_extract_all(left, F.lit(_SIX), F.lit(0)), F.regexp_extract_all(left, F.lit(_SIX_BARE), F.lit(0)))
        keys = F.transform(hosts, lambda h: F.concat(F.lit("["), ipv6_key(F.regexp_replace(h, r"[\[\]]", "")), F.lit("]")))
        return F.struct(x["ibans"].alias("ibans"), F.regexp_replace(left, _SIX, "\n").alias("bare"), F.concat(named("url", urls), named("host", keys)).alias("found"))

    return _let(F.regexp_replace(x["bare"], _SIX_URL, "\n"), rest)


def _tokens(x: Column) -> Column:
    numbers = F.transform(F.filter(F.regexp_extract_all(x["bare"], F.lit(_GROUPED), F.lit(0)), lambda g: ~g.rlike(r"[0-9]{4}-[0-9]{2}-[0-9]{2}")), lambda g: F.regexp_replace(g, "[ -]", ""))
    some = F.filter(F.split(x["bare"], _CUT), lambda w: (F.length(w) >= 4) & w.rlike(r"[0-9@/\\.]"))
    tokens = F.array_distinct(F.concat(F.transform(some, lambda w: F.regexp_replace(w, r"^[,;:]+|[.,;:!?]+$", "")), x["ibans"], numbers))
    found = F.filter(F.transform(F.filter(tokens, lambda w: (F.length(w) >= 4) & w.rlike(r"[0-9@/\\.]")), _typed), lambda v: F.length(v["key"]) >= 3)
    return F.array_distinct(F.concat(found, x["found"]))


def keys_of(found: Column, *without: str) -> Column:
    """array<string>, sorted: the keys of values of other kinds than those; `authority` values are those without ids."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(found, lambda v: ~v["kind"].isin(*without)) if without else found, lambda v: v["key"])))


def authority_keys(found: Column) -> Column:
    return keys_of(found, "id")


def parsed(key: Column) -> Column:
    """struct<kind, host, segments> of a canonical key: url, path, email, host or other."""
    path = key.contains("/") | key.startswith("~")
    kind = F.when(key.contains("://"), "url").when(path, "path").when(key.contains("@"), "email").when(key.rlike(rf"^(?:{_HOST}|{IPV4}|{_SIX})$"), "host").otherwise("other")
    rest = F.regexp_replace(F.regexp_replace(key, "^[^:]+://", ""), r"\?.*$", "")

    def apart(k: Column) -> Column:
        host = F.when(k["kind"] == "url", F.split_part(k["rest"], F.lit("/"), F.lit(1))).when(k["kind"] == "email", F.regexp_extract(k["key"], "@([^@]*)$", 1)).when(k["kind"] == "host", k["key"]).otherwise("")
        steps = F.when(k["kind"] == "url", F.slice(F.split(k["rest"], "/"), 2, 1 << 20)).when(k["kind"] == "path", F.split(k["key"], "/")).otherwise(F.array().cast("array<string>"))
        return F.struct(k["kind"].alias("kind"), host.alias("host"), F.filter(steps, lambda s: s != "").alias("segments"))

    return _let(F.struct(kind.alias("kind"), rest.alias("rest"), key.alias("key")), apart)


def host_suffixes(host: Column, first: int = 0) -> Column:
    """The host (from label `first` on) and its parents of two labels or more; of an address only itself, of 127 labels at most."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    parents = F.transform(F.sequence(F.greatest(F.lit(first + 1), n - 126), F.greatest(n - 1, F.lit(first + 1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    none = F.array().cast("array<string>")
    return F.when(host.rlike(rf"^(?:{IPV4}|\[.*)$"), F.array(host) if first == 0 else none).when(n - 1 >= first + 1, parents).otherwise(none)


_FIRST = r"(?:^|\.)(?:" + "|".join(h.replace(".", r"\.") for h in FIRST_PARTIES) + ")$"


def shared_host(host: Column) -> Column:
    """A first-party site or what lies under it, or the bare suffix of a platform that rents out names (a name under that is somebody's own)."""
    return host.isin(*TENANT_SUFFIXES) | host.rlike(_FIRST)


def owner_suffixes(host: Column) -> Column:
    """The host and those parents that one owner runs: no shared site, no registry's label."""
    registry = lambda s: (F.size(F.split(s, r"\.")) == 2) & F.split_part(s, F.lit("."), F.lit(1)).isin(*REGISTRY_LABELS)
    return F.filter(host_suffixes(host), lambda s: (s == host) | (~shared_host(s) & ~registry(s)))


def exact_forms(value: Column) -> Column:
    """What a value may be listed as: itself, a URL without query and fragment, and either without www."""
    stem = F.when(value.contains("://"), F.rtrim(F.regexp_replace(value, "[?#].*$", ""), F.lit("/"))).otherwise(value)
    bare = lambda v: F.regexp_replace(v, r"^([a-z][a-z0-9+.-]*://)www\.", "$1")
    return F.array_distinct(F.array(value, stem, bare(value), bare(stem)))


def domain_of(value: Column) -> Column:
    """The host of a URL, e-mail address or bare host, without www.; null for accounts and paths."""

    def domain(p: Column) -> Column:
        host = F.regexp_replace(p["host"], r"^www\.", "")
        return F.when(p["kind"].isin("url", "email", "host") & host.rlike(rf"^(?:{_HOST}|{IPV4}|{_SIX})$"), host)

    return _let(parsed(value), domain)


def joined_to(cwd: Column, path: Column) -> Column:
    """A relative path's key under a folder; null for an absolute one."""
    return F.when(cwd.startswith("/") & ~path.rlike("^[/~]"), path_key(F.concat(cwd, F.lit("/"), path)))
