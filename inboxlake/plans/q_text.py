"""Message-text queries over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.partitioning import spread
from .catalog import query

NL = "chr(10)"
_TRIM = "' ' || chr(9) || chr(10) || chr(13) || chr(11)"


def d_trim(x: str) -> str:
    return f"trim({x}, {_TRIM})"


def d_strip_quotes(x: str) -> str:
    lines = f"string_split(coalesce({x}, ''), {NL})"
    flags = (f"list_transform({lines}, lambda l: starts_with({d_trim('l')}, '>') "
             f"OR regexp_matches({d_trim('l')}, '^On .+ wrote:$') "
             f"OR regexp_matches({d_trim('l')}, '(?i)^-{{2,}}\\s*Original Message\\s*-{{2,}}'))")
    pos = f"coalesce(list_position({flags}, true), 0)"
    kept = f"CASE WHEN {pos} > 0 THEN list_slice({lines}, 1, {pos} - 1) ELSE {lines} END"
    return d_trim(f"array_to_string({kept}, {NL})")


def d_decode(x: str) -> str:
    out = x
    for ent, ch in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&copy;", "chr(169)"),
                    ("&middot;", "chr(183)"), ("&amp;", "'&'")):
        out = f"replace({out}, '{ent}', {ch})"
    return out


def d_collapse(x: str) -> str:
    t = f"regexp_replace({x}, '[ \\t]+(\\n|\\z)', '\\1', 'g')"
    t = f"regexp_replace({t}, '\\n{{3,}}', {NL} || {NL}, 'g')"
    t = f"regexp_replace({t}, '[ \\t]{{2,}}', ' ', 'g')"
    return d_trim(t)


def d_strip_tags(x: str) -> str:
    return f"regexp_replace({x}, '<(?:[^\\s>][^>]*)?(?:>|\\z)', '', 'g')"


def d_html_to_text(x: str) -> str:
    h = f"regexp_replace({x}, '(?s)<!--.*?-->', '', 'g')"
    h = f"regexp_replace({h}, '(?is)<style\\b[^>]*>.*?</style>', '', 'g')"
    h = f"regexp_replace({h}, '(?is)<script\\b[^>]*>.*?</script>', '', 'g')"
    h = f"regexp_replace({h}, '(?i)<br\\s*/?>', {NL}, 'g')"
    h = f"regexp_replace({h}, '(?i)</?(?:{tx._BLOCK_TAGS})\\b[^>]*>', {NL}, 'g')"
    h = f"regexp_replace({h}, '(?i)</?(?:td|th)\\b[^>]*>', ' ', 'g')"
    return f"regexp_replace({h}, '<[^>]*>', '', 'g')"


def _quoted(conv):
    """Conversation turns with injected reply quotes of three kinds."""
    t, role, nl = F.col("text"), F.col("role"), F.lit("\n")
    k = F.col("turn") % 4
    return conv.select("conv_id", "turn", F.when(
        k == 1, F.concat(t, nl, nl, F.lit("On Mon, "), role, F.lit(" wrote:"), nl, F.lit("> "), t)).when(
        k == 2, F.concat(t, nl, F.lit("  -----Original Message-----  "), nl, F.lit("From: "), role)).when(
        k == 3, F.concat(F.lit("> "), role, nl, t)).otherwise(t).alias("text"))


_QUOTED_SQL = f"""SELECT conv_id, turn, CASE turn % 4
   WHEN 1 THEN text || {NL} || {NL} || 'On Mon, ' || role || ' wrote:' || {NL} || '> ' || text
   WHEN 2 THEN text || {NL} || '  -----Original Message-----  ' || {NL} || 'From: ' || role
   WHEN 3 THEN '> ' || role || {NL} || text ELSE text END AS text FROM conversations"""


@query("strip_quotes", oracle=f"""SELECT conv_id, turn, length(s) AS n_chars, md5(s) AS text_md5
FROM (SELECT conv_id, turn, {d_strip_quotes('text')} AS s FROM ({_QUOTED_SQL}))""")
def strip_quotes(fx):
    """quoted-reply stripping over every conversation turn (quotes injected)."""
    s = tx.strip_quoted_replies(F.col("text"))
    return _quoted(fx.t.conversations).select("conv_id", "turn", F.length(s).alias("n_chars"),
                                              F.md5(s).alias("text_md5"))


def _noisy(conv):
    t, nl, tab = F.col("text"), F.lit("\n"), F.lit("\t")
    return conv.select("conv_id", "turn", F.concat(
        t, F.lit("  "), tab, nl, nl, nl, nl, F.lit("a  &amp;  b &lt;i&gt;"), tab, tab,
        F.lit(" c &quot;d&quot; &copy; "), F.col("role"), F.lit("   ")).alias("text"))


_NOISY_SQL = f"""SELECT conv_id, turn, text || '  ' || chr(9) || {NL} || {NL} || {NL} || {NL} || 'a  &amp;  b &lt;i&gt;'
  || chr(9) || chr(9) || ' c &quot;d&quot; &copy; ' || role || '   ' AS text FROM conversations"""


@query("normalize_whitespace", oracle=f"""SELECT conv_id, turn, length(s) AS n_chars, md5(s) AS text_md5
FROM (SELECT conv_id, turn, {d_strip_tags(d_collapse(d_decode('text')))} AS s FROM ({_NOISY_SQL}))""")
def normalize_whitespace(fx):
    """F5 + F7: entity decoding, whitespace collapse, then tag stripping (encoded tags vanish)."""
    s = tx.strip_tags(tx.normalize_whitespace(F.col("text")))
    return _noisy(fx.t.conversations).select("conv_id", "turn", F.length(s).alias("n_chars"),
                                             F.md5(s).alias("text_md5"))


@query("html_to_text", oracle=f"""SELECT page_id, length(s) AS n_chars, md5(s) AS text_md5
FROM (SELECT page_id, {d_strip_tags(d_collapse(d_decode(d_strip_quotes(d_html_to_text('html')))))} AS s FROM pages)""")
def html_to_text(fx):
    """F6 + F7: HTML-only bodies to clean text (the ingest's body choice with an empty plain part)."""
    s = tx.clean_body(F.lit(None).cast("string"), F.col("html"))
    pages = spread(fx.t.pages.select("page_id", "html"))
    return pages.select("page_id", F.length(s).alias("n_chars"), F.md5(s).alias("text_md5"))


_ADDR = """CASE page_id % 5 WHEN 0 THEN 'nodomain' || CAST(page_id AS VARCHAR)
  WHEN 1 THEN 'a@b@' || upper(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1))
  WHEN 2 THEN ''
  ELSE 'user' || CAST(page_id AS VARCHAR) || '@' || upper(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) END"""


@query("sender_domain", oracle=f"""SELECT page_id, addr,
  CASE WHEN instr(addr, '@') > 0 THEN lower(regexp_extract(addr, '@([^@]*)$', 1)) ELSE '' END AS sender_domain
FROM (SELECT page_id, {_ADDR} AS addr FROM pages)""")
def sender_domain(fx):
    """sender domain of addresses built from page hosts (with no-@, double-@ and empty cases)."""
    host = F.upper(F.regexp_extract("url", r"^[a-z]+://([^/?#:]+)", 1))
    pid = F.col("page_id")
    addr = (F.when(pid % 5 == 0, F.concat(F.lit("nodomain"), pid.cast("string")))
             .when(pid % 5 == 1, F.concat(F.lit("a@b@"), host))
             .when(pid % 5 == 2, F.lit(""))
             .otherwise(F.concat(F.lit("user"), pid.cast("string"), F.lit("@"), host)))
    return fx.t.pages.select("page_id", addr.alias("addr")).withColumn("sender_domain", tx.sender_domain(F.col("addr")))


@query("thread_id", oracle="""SELECT conv_id, turn, CASE
  WHEN coalesce(refs, '') <> '' AND regexp_extract(refs, '<([^>]+)>', 1) <> '' THEN regexp_extract(refs, '<([^>]+)>', 1)
  ELSE coalesce(message_id, CAST(uid AS VARCHAR)) END AS thread_id
FROM (SELECT conv_id, turn,
  CASE WHEN turn % 5 = 4 THEN NULL ELSE 'm' || CAST(conv_id AS VARCHAR) || '.' || CAST(turn AS VARCHAR) || '@mail.example' END AS message_id,
  CASE WHEN turn = 0 THEN NULL WHEN turn % 3 = 0 THEN 'm' || CAST(conv_id AS VARCHAR) || '.0@mail.example'
       ELSE '<m' || CAST(conv_id AS VARCHAR) || '.0@mail.example> <m' || CAST(conv_id AS VARCHAR) || '.' || CAST(turn - 1 AS VARCHAR) || '@mail.example>' END AS refs,
  conv_id * 1000 + turn AS uid FROM conversations)""")
def thread_id(fx):
    """thread id from References / Message-ID / uid for every conversation turn."""
    c, t = F.col("conv_id").cast("string"), F.col("turn")
    mid = F.when(t % 5 == 4, F.lit(None)).otherwise(
        F.concat(F.lit("m"), c, F.lit("."), t.cast("string"), F.lit("@mail.example")))
    refs = (F.when(t == 0, F.lit(None))
             .when(t % 3 == 0, F.concat(F.lit("m"), c, F.lit(".0@mail.example")))
             .otherwise(F.concat(F.lit("<m"), c, F.lit(".0@mail.example> <m"), c, F.lit("."),
                                 (t - 1).cast("string"), F.lit("@mail.example>"))))
    uid = F.col("conv_id") * 1000 + t
    return fx.t.conversations.select("conv_id", "turn", tx.resolve_thread_id(refs, mid, uid).alias("thread_id"))


@query("embedding_text", oracle="""SELECT id, length(s) AS n_chars, md5(s) AS text_md5 FROM (
  SELECT id, trim(coalesce(subject, '') || ' ' || coalesce(body, ''), ' ' || chr(9) || chr(10) || chr(13) || chr(11)) AS s
  FROM emails_v)""")
def embedding_text(fx):
    """the text a message is embedded from."""
    s = tx.embedding_text(F.col("subject"), F.col("body"))
    return fx.emails.select("id", F.length(s).alias("n_chars"), F.md5(s).alias("text_md5"))
