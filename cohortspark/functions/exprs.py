"""Column helpers: classification, tolerant casts, calendar arithmetic, text and URL clean-up.

Everything here is a Column expression, so it stays inside whole-stage codegen.
"""

from functools import reduce

from pyspark.sql import Column, functions as F, types as T


def col(c):
    return c if isinstance(c, Column) else F.col(c)


# ---------------------------------------------------------------- predicates and projections


def classify(rules, default=None):
    """Ordered rule chain: ``rules`` is a list of (condition, value), the first match wins."""
    chain = None
    for condition, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    default = default if isinstance(default, Column) else F.lit(default)
    return chain.otherwise(default) if chain is not None else default


def ilike_any(c, patterns):
    return reduce(lambda a, b: a | b, [col(c).ilike(p) for p in patterns])


def safe_div(num, den, on_zero=None):
    """num / den; NULL on a zero denominator, or ``on_zero`` when one is given."""
    num, den = col(num).cast("double"), col(den).cast("double")
    if on_zero is None:
        return num / F.nullif(den, F.lit(0.0))
    return F.when(den == 0, F.lit(float(on_zero))).otherwise(num / F.nullif(den, F.lit(0.0)))


def try_num(c, to="double"):
    return F.trim(col(c).cast("string")).try_cast(to)


def to_binary(c, true_values=("true", "1", "yes", "y", "t")):
    """Text, number or boolean label -> 1/0; NULL stays NULL."""
    text = F.lower(F.trim(col(c).cast("string")))
    return F.when(text.isNull(), F.lit(None)).when(text.isin(*true_values), 1).otherwise(0).cast("int")


def select_columns(df, prefixes=None, exclude=(), types=None):
    """Names of the columns that have one of the prefixes and types and are not excluded."""
    dropped = {e.lower() for e in exclude}
    kept = []
    for field in df.schema.fields:
        name = field.name.lower()
        if name in dropped or (prefixes and not name.startswith(tuple(p.lower() for p in prefixes))):
            continue
        if types and not isinstance(field.dataType, tuple(types)):
            continue
        kept.append(field.name)
    return kept


NUMERIC = (T.NumericType,)


# ---------------------------------------------------------------- calendar


def micros(ts):
    """Microseconds since 1970-01-01 by wall clock; the same in every session time zone."""
    ts = col(ts)
    second = (F.extract(F.lit("SECOND"), ts) * 1000000).cast("bigint")
    return (
        F.unix_date(F.to_date(ts)).cast("bigint") * 86400000000
        + F.hour(ts).cast("bigint") * 3600000000
        + F.minute(ts).cast("bigint") * 60000000
        + second
    )


def from_micros(us):
    """Inverse of ``micros``: a TIMESTAMP_NTZ."""
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        secs=(col(us).cast("decimal(18,0)") / F.lit(1000000).cast("decimal(7,0)")).cast("decimal(18,6)")
    )


_SPAN = {"SECOND": 1000000, "MINUTE": 60000000, "HOUR": 3600000000}


def boundary_diff(unit, a, b):
    """Number of ``unit`` boundaries crossed going from a to b (not elapsed whole units)."""
    unit = unit.upper()
    a, b = col(a), col(b)
    if unit in _SPAN:
        span = F.lit(_SPAN[unit])
        return (F.floor(micros(b) / span) - F.floor(micros(a) / span)).cast("bigint")
    if unit == "DAY":
        return F.datediff(F.to_date(b), F.to_date(a)).cast("bigint")
    if unit == "WEEK":  # Monday weeks: 1970-01-05 was a Monday
        week = lambda x: F.floor((F.unix_date(F.to_date(x)) - 4) / 7)
        return (week(b) - week(a)).cast("bigint")
    months = {"MONTH": 1, "QUARTER": 3, "YEAR": 12}[unit]
    index = lambda x: F.floor((F.year(x) * 12 + F.month(x) - 1) / months)
    return (index(b) - index(a)).cast("bigint")


def trunc_ts(unit, ts):
    return F.date_trunc(unit, col(ts)).cast("timestamp_ntz")


def time_slice(ts, seconds):
    """Start of the ``seconds``-wide slice that holds ts."""
    span = F.lit(int(seconds) * 1000000)
    return from_micros(F.floor(micros(ts) / span) * span)


def zone_shift(ts, to_zone, from_zone="UTC"):
    from_zone = from_zone if isinstance(from_zone, Column) else F.lit(from_zone)
    to_zone = to_zone if isinstance(to_zone, Column) else F.lit(to_zone)
    return F.convert_timezone(from_zone, to_zone, col(ts).cast("timestamp_ntz"))


def day_of_week(ts):
    """Sunday = 0 ... Saturday = 6."""
    return F.dayofweek(col(ts)) - 1


def day_part(ts, bounds=((5, "late night"), (11, "morning"), (14, "lunch"), (17, "afternoon"), (21, "dinner")),
             last="night"):
    """Label of the first bound greater than the hour."""
    hour = F.hour(col(ts))
    return classify([(hour < upper, label) for upper, label in bounds], last)


def dow_close(a, b):
    """Day-of-week numbers at most one apart, with Saturday next to Sunday."""
    gap = F.abs(col(a) - col(b))
    return (gap <= 1) | (gap == 6)


def plus(ts, **parts):
    """ts + interval, e.g. ``plus("ts", days=7, hours=-1)``."""
    secs = (parts.get("weeks", 0) * 604800 + parts.get("days", 0) * 86400 + parts.get("hours", 0) * 3600
            + parts.get("minutes", 0) * 60 + parts.get("seconds", 0))
    return col(ts) + F.make_dt_interval(secs=F.lit(secs).cast("decimal(18,6)"))


# ---------------------------------------------------------------- text


def normalize_device_id(c):
    """Lower case, ``dx_`` in front unless it matches LIKE 'dx_%', and no dashes."""
    text = col(c)
    return F.replace(F.lower(F.when(text.like("dx_%"), text).otherwise(F.concat(F.lit("dx_"), text))), F.lit("-"), F.lit(""))


def parse_badge_volume(c):
    """Number in a ``[12+ ...]`` / ``[1k+ ...]`` badge, else NULL."""
    digits = F.regexp_extract(col(c), r"\[(\d+)(k?)\+", 1)
    kilo = F.regexp_extract(col(c), r"\[(\d+)(k?)\+", 2)
    return F.when(digits != "", digits.try_cast("bigint") * F.when(kilo == "k", 1000).otherwise(1))


def slugify(c):
    text = F.regexp_replace(F.lower(F.trim(col(c))), r"[^a-z0-9]+", "-")
    return F.regexp_replace(text, r"^-+|-+$", "")


# Country code, calling prefix and number of national digits.
PHONE_RULES = {"US": ("1", 10), "CA": ("1", 10), "AU": ("61", 9), "NZ": ("64", 9)}


def valid_e164(phone, country, rules=None):
    """The number has its country's prefix and digit count."""
    rules = rules or PHONE_RULES
    text = F.regexp_replace(col(phone), r"[\s().-]", "")
    return classify(
        [(col(country) == code, text.rlike(rf"^\+{prefix}\d{{{digits}}}$")) for code, (prefix, digits) in rules.items()],
        False,
    )


# LIKE patterns (any letter case, _ is any character) of user agents, tried in this order, and their names.
BROWSER_NAMES = (
    ("%FBAV%", "Facebook In-App"), ("%FB_IAB%", "Facebook In-App"), ("%Instagram%", "Instagram In-App"), ("%TikTok%", "TikTok In-App"),
    ("%Twitter%", "Twitter In-App"), ("%Snapchat%", "Snapchat In-App"), ("%Pinterest%", "Pinterest In-App"), ("%LinkedIn%", "LinkedIn In-App"),
    ("%OPR%", "Opera"), ("%Opera%", "Opera"), ("%Edg%", "Edge"), ("%Chrome%", "Chrome"), ("%CriOS%", "Chrome iOS"), ("%FxiOS%", "Firefox iOS"),
    ("%Firefox%", "Firefox"), ("%Safari%", "Safari"), ("%SamsungBrowser%", "Samsung Internet"), ("%UCBrowser%", "UC Browser"),
    ("%YaBrowser%", "Yandex"), ("%Brave%", "Brave"), ("%Vivaldi%", "Vivaldi"), ("%DuckDuckGo%", "DuckDuckGo"), ("%QQBrowser%", "QQ Browser"),
    ("%Maxthon%", "Maxthon"), ("%Sogou%", "Sogou"), ("%Puffin%", "Puffin"), ("%Naver%", "Naver Whale"))
# User agents of renderers and readers, left out of visitor tables.
NO_VISITOR = ("%prerender%", "%read-aloud%")


def browser_name(c):
    """Browser or in-app browser of a user agent, ``Other`` if none is known or the agent is NULL."""
    return classify([(col(c).ilike(pattern), name) for pattern, name in BROWSER_NAMES], "Other")


def is_visitor(c):
    """The user agent is neither a renderer nor a reader (NULL for a NULL agent)."""
    return ~reduce(lambda a, b: a | b, [col(c).ilike(p) for p in NO_VISITOR])


# Calling prefix, allowed lengths of the whole number with its plus sign.
PHONE_LENGTHS = (("+1", (11, 12)), ("+61", (11, 12, 13)), ("+64", (11, 12)), ("+52", (12, 13)), ("+81", (12, 13)))


def telephone(c):
    """The number if it can be E.164, else NULL: a plus sign, 8 to 16 characters, not only zeros, the length its calling
    prefix asks for where that is known, and at least 6 characters after the prefix. Other countries pass on the
    general rules."""
    text, size = col(c), F.length(col(c))
    bad = ~text.startswith("+") | (size < 8) | (size > 16) | (F.replace(text.substr(F.lit(2), size), F.lit("0"), F.lit("")) == "")
    for prefix, lengths in PHONE_LENGTHS:
        bad = bad | (text.startswith(prefix) & (~size.isin(*lengths) | (size - len(prefix) < 6)))
    return F.when(~bad, text)


# Lower-case user-agent substrings, tried in this order.
BROWSER_RULES = (("edg/", "edge"), ("opr/", "opera"), ("samsungbrowser", "samsung"), ("crios", "chrome"),
                 ("chrome", "chrome"), ("fxios", "firefox"), ("firefox", "firefox"), ("safari", "safari"))
OS_RULES = (("iphone", "ios"), ("ipad", "ios"), ("android", "android"), ("windows", "windows"),
            ("mac os", "macos"), ("cros", "chromeos"), ("linux", "linux"))
BOT_WORDS = ("bot", "crawler", "spider", "headless", "preview")


def classify_user_agent(c):
    """Struct of browser, os and is_bot."""
    text = F.lower(col(c))
    return F.struct(
        classify([(text.contains(s), name) for s, name in BROWSER_RULES], "other").alias("browser"),
        classify([(text.contains(s), name) for s, name in OS_RULES], "other").alias("os"),
        reduce(lambda a, b: a | b, [text.contains(w) for w in BOT_WORDS]).cast("int").alias("is_bot"),
    )


def percent_promo(c):
    """The text holds a literal percent sign (not the LIKE wildcard)."""
    return col(c).contains("%")


def url_path(c):
    return F.parse_url(col(c), F.lit("PATH"))


def url_param(c, name):
    return F.parse_url(col(c), F.lit("QUERY"), F.lit(name))


def hash_bucket(c, n):
    """Stable bucket 0..n-1 of a key."""
    return F.pmod(F.xxhash64(col(c)), F.lit(n)).cast("int")


def md5_bucket64(c):
    """The first 32 bits of md5 as a number."""
    return F.conv(F.substring(F.md5(col(c).cast("string")), 1, 8), 16, 10).cast("bigint")


def md5_bucket(c, n):
    """Bucket 0..n-1 from the first 8 hex digits of md5: reproducible in other engines."""
    return (md5_bucket64(c) % n).cast("int")


def bin_edges(c, edges, labels=None):
    """Right-open bins: value < edges[0] -> first label, ... , else the last label."""
    labels = labels or list(range(len(edges) + 1))
    value = col(c)
    return F.when(value.isNull(), F.lit(None)).otherwise(
        classify([(value < edge, label) for edge, label in zip(edges, labels)], labels[-1])
    )


def width_bin(c, width):
    """Lower edge of the fixed-width bin that holds the value."""
    return (F.floor(col(c) / F.lit(width)) * F.lit(width)).cast("bigint")


def prob1(vector_col):
    """Probability of class 1 from a Spark ML probability vector, without a UDF."""
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(col(vector_col))[1]


def ratio_moment(count, total, total_sq):
    """Sample variance from count, sum and sum of squares (NULL for fewer than two rows)."""
    n = col(count).cast("double")
    return F.when(n > 1, (col(total_sq) - col(total) * col(total) / n) / (n - 1))
