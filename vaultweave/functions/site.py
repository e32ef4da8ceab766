"""Column functions of the site's markdown dialects and links: wikilinks in parts, blocks, callouts, slugs and paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vaultweave.functions.markdown import heading_slug
from vaultweave.functions.slugs import simplify_slug, slugify_path

# Callout names and the kind each stands for.
CALLOUTS = {
    "note": "note", "abstract": "abstract", "summary": "abstract", "tldr": "abstract", "info": "info", "todo": "todo", "tip": "tip", "hint": "tip", "important": "tip",
    "success": "success", "check": "success", "done": "success", "question": "question", "help": "question", "faq": "question", "warning": "warning", "attention": "warning",
    "caution": "warning", "failure": "failure", "missing": "failure", "fail": "failure", "danger": "danger", "error": "danger", "bug": "bug", "example": "example", "quote": "quote", "cite": "quote",
}
# Arrows and the entity each becomes, longer ones first.
ARROWS = (("<==", "&lArr;"), ("<--", "&lArr;"), ("==>", "&rArr;"), ("-->", "&rArr;"), ("<=", "&lArr;"), ("<-", "&larr;"), ("=>", "&rArr;"), ("->", "&rarr;"))
#: One wikilink: embedded or not, then target, anchors and alias, each optional.
SITE_LINK = r"!?\[\[(?:[^\[\]|#\\]+)?(?:#+[^\[\]|#\\]+)?(?:\\?\|[^\[\]#]*)?\]\]"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def _or_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def site_links(text: Column) -> Column:
    """Every wikilink as (embed, target, heading, block, alias), in order; parts that are not there are null.

    A heading is what follows ``#`` (the last one of several), a block what follows ``#^``.
    """

    def parts(link: Column) -> Column:
        anchor = F.regexp_extract(link, r"(#+[^\[\]|#\\]+)", 1)
        name = F.trim(F.regexp_replace(anchor, "^#+", ""))
        is_block = name.startswith("^")
        return F.struct(
            link.startswith("!").alias("embed"), _or_null(F.trim(F.regexp_extract(link, r"\[\[([^\[\]|#\\]+)", 1))).alias("target"),
            F.when(~is_block, _or_null(name)).alias("heading"), F.when(is_block, F.substr(name, F.lit(2))).alias("block"),
            _or_null(F.trim(F.regexp_extract(link, r"\|([^\[\]#]*)\]\]", 1))).alias("alias"),
        )

    return F.transform(_found(text, SITE_LINK, 0), parts)


def block_references(text: Column) -> Column:
    """The block ids (``^id`` at the end of a line), in order."""
    return _found(text, r"(?md)(?:^|[ \t])\^([-_A-Za-z0-9]+)[ \t\r]*$")


def without_comments(text: Column) -> Column:
    """``text`` without what stands between ``%%`` and ``%%``."""
    return F.regexp_replace(text, r"(?s)%%.*?%%", "")


def highlights(text: Column) -> Column:
    """What stands between ``==`` and ``==``."""
    return _found(text, r"==([^=]+)==")


def callouts(text: Column) -> Column:
    """(kind, title, fold) of each callout: its canonical kind (an unknown one as it is), its title or null, ``+`` or ``-`` if it folds."""
    kinds = F.create_map(*[F.lit(x) for kv in CALLOUTS.items() for x in kv])

    def parts(line: Column) -> Column:
        kind = F.regexp_extract(line, r"\[!([\w-]+)", 1)
        return F.struct(
            F.coalesce(F.try_element_at(kinds, F.lower(kind)), kind).alias("kind"), _or_null(F.trim(F.regexp_extract(line, r"\][+-]?([^\r\n]*)$", 1))).alias("title"),
            _or_null(F.regexp_extract(line, r"\]([+-])", 1)).alias("fold"),
        )

    return F.transform(_found(text, r"(?md)^> *(\[![\w-]+[^\]\r\n]*\][^\r\n]*)"), parts)


def checkboxes(text: Column) -> tuple[Column, Column]:
    """(open, done): the task items of a text."""
    return F.regexp_count(text, F.lit(r"(?md)^[ \t]*[-*+] \[ \] ")), F.regexp_count(text, F.lit(r"(?md)^[ \t]*[-*+] \[[xX]\] "))


def with_arrows(text: Column) -> Column:
    """``text`` with arrows as entities."""
    # Placeholders keep an arrow from being found in one already made.
    marked = reduce(lambda t, i: F.replace(t, F.lit(ARROWS[i][0]), F.lit(chr(0xE000 + i))), range(len(ARROWS)), text)
    return reduce(lambda t, i: F.replace(t, F.lit(chr(0xE000 + i)), F.lit(ARROWS[i][1])), range(len(ARROWS)), marked)


def video_id(url: Column) -> Column:
    """The id of a YouTube address, null for any other."""
    found = F.regexp_extract(url, r"^.*(?:youtu.be/|v/|u/\w/|embed/|watch\?v=|&v=)([^#&?]*).*", 1)
    return F.when(F.length(found) == 11, found)


def embed_kind(target: Column) -> Column:
    """What an embedded target is, by its ending: image, video, audio, pdf or page."""
    ext = F.lower(F.regexp_extract(target, r"\.([A-Za-z0-9]+)$", 1))
    return (
        F.when(ext.isin("png", "jpg", "jpeg", "gif", "bmp", "svg", "webp"), "image")
        .when(ext.isin("mp4", "webm", "ogv", "mov", "mkv"), "video")
        .when(ext.isin("mp3", "wav", "m4a", "ogg", "3gp", "flac"), "audio")
        .when(ext == "pdf", "pdf")
        .otherwise("page")
    )


def from_roam(text: Column) -> Column:
    """Roam's dialect as markdown: ``{{or:a|b}}``, TODO and DONE boxes, ``^^highlight^^``, ``__italic__`` and ``[[>]]`` quotes."""
    t = F.regexp_replace(text, r"\{\{\[\[TODO\]\]\}\}", "[ ]")
    t = F.regexp_replace(t, r"\{\{\[\[DONE\]\]\}\}", "[x]")
    t = F.regexp_replace(t, r"\{\{or:([^}]*)\}\}", "($1)")
    t = F.regexp_replace(t, r"\^\^(.+?)\^\^", "==$1==")
    t = F.regexp_replace(t, r"__(.+?)__", "*$1*")
    return F.regexp_replace(t, r"(?md)^(\[\[>\]\])[ \t]*([^\r\n]*)", "> $2")


def from_hugo(text: Column) -> Column:
    """ox-hugo's dialect as markdown: relrefs as links, no heading anchors, shortcodes opened, figures as images, org formulas in dollars."""
    t = F.regexp_replace(text, r'\[([^\]]+)\]\(\{\{< relref "([^"]+)" >\}\}\)', "[$1]($2)")
    t = F.regexp_replace(t, r"(?d)([^\r\n]*) \{#[^\r\n]*\}", "$1")
    t = F.regexp_replace(t, r"(?d)\{\{([^\r\n]*)\}\}", "$1")
    t = F.regexp_replace(t, r'(?d)< ?figure src="([^\r\n]*)" ?>', "![]($1)")
    t = F.regexp_replace(t, r"(?d)\\\\\((.+?)\\\\\)", r"\$$1\$")
    t = F.regexp_replace(t, r"(?s)(?:\\begin\{equation\}|\\\\\(|\\\\\[)(.*?)(?:\\\\\]|\\\\\)|\\end\{equation\})", r"\$\$$1\$\$")
    # An escaped underscore counts as one inside a formula only.
    pieces = F.regexp_extract_all(t, F.lit(r"(?s)\$\$.*?\$\$|\$[^\r\n]*?\$|[^$]+|\$"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.startswith("$"), F.replace(p, F.lit("\\_"), F.lit("_"))).otherwise(p)), "")


# -- slugs and paths ---------------------------------------------------------------


def ends_with(slug: Column, suffix: str) -> Column:
    """Whether a path is ``suffix`` or ends with it as a segment."""
    return (slug == suffix) | slug.endswith("/" + suffix)


def strip_slashes(slug: Column, only_first: bool = False) -> Column:
    """A path without its first slash, and its last one unless told otherwise."""
    s = F.regexp_replace(slug, "^/", "")
    return s if only_first else F.regexp_replace(s, "/$", "")


def is_folder_path(path: Column) -> Column:
    """Whether a path names a folder: by a final slash or an index page."""
    return path.endswith("/") | ends_with(path, "index") | ends_with(path, "index.md") | ends_with(path, "index.html")


def file_extension(path: Column) -> Column:
    """The ending of a path with its dot, null without one."""
    return _or_null(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1))


def slug_kind(s: Column) -> Column:
    """(file, full, simple, relative, absolute): which kinds of path or address a text is."""
    bad = s.rlike(r"[ #?&]")
    has_ext = file_extension(s).isNotNull()
    return F.struct(
        (~s.startswith(".") & has_ext).alias("file"),
        (~s.rlike(r"^[./]") & ~s.endswith("/") & ~bad).alias("full"),
        (~s.startswith(".") & ~((F.length(s) > 1) & s.startswith("/")) & ~bad & ~ends_with(s, "index") & ~has_ext).alias("simple"),
        (s.startswith(".") & ~ends_with(s, "index") & ~F.coalesce(file_extension(s).isin(".md", ".html"), F.lit(False))).alias("relative"),
        s.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:.").alias("absolute"),
    )


def split_anchor(link: Column) -> tuple[Column, Column]:
    """(path, anchor): the anchor as a heading's slug with its ``#``, as written for a pdf, empty without one."""
    path = F.substring_index(link, "#", 1)
    raw = F.when(link.contains("#"), F.regexp_extract(link, "#([^#]*)", 1))
    anchor = F.when(path.endswith(".pdf"), raw).otherwise(heading_slug(raw))
    return path, F.when(raw.isNull(), F.lit("")).otherwise(F.concat(F.lit("#"), anchor))


def path_to_root(slug: Column) -> Column:
    """One ``..`` for each folder a page lies in, ``.`` at the root."""
    depth = F.size(F.filter(F.split(slug, "/"), lambda x: x != "")) - 1
    return F.when(depth > 0, F.array_join(F.array_repeat(F.lit(".."), depth), "/")).otherwise(F.lit("."))


def join_segments(*parts: Column) -> Column:
    """Paths joined by one slash each; a slash at the very start or end stays."""
    kept = F.filter(F.array(*parts), lambda p: (p != "") & (p != "/"))
    joined = F.array_join(F.transform(kept, lambda p: strip_slashes(p)), "/")
    first = F.when(parts[0].startswith("/"), F.lit("/")).otherwise(F.lit(""))
    return F.concat(first, joined, F.when(parts[-1].endswith("/"), F.lit("/")).otherwise(F.lit("")))


def resolve_relative(current: Column, target: Column) -> Column:
    """``target`` as seen from the page ``current``."""
    return join_segments(path_to_root(current), simplify_slug(target))


def internal_link(link: Column) -> Column:
    """A link as a relative address: slug of its path, dots in front kept, folders with a slash, then the anchor."""
    path, anchor = split_anchor(link)
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    dots = F.array_join(F.filter(segments, lambda x: x.rlike(r"^\.{1,2}$")), "/")
    rest = F.array_join(F.filter(segments, lambda x: ~x.rlike(r"^\.{1,2}$")), "/")
    simple = F.when(rest == "", F.lit("/")).otherwise(simplify_slug(slugify_path(rest)))
    joined = join_segments(strip_slashes(dots), strip_slashes(simple))
    # Addresses that do not begin with dots begin here.
    started = F.when(joined == "", F.lit(".")).when(joined.rlike(r"^\.{1,2}(/|$)"), joined).otherwise(F.concat(F.lit("./"), joined))
    return F.concat(started, F.when(is_folder_path(path), F.lit("/")).otherwise(F.lit("")), anchor)


def slug_tag(tag: Column) -> Column:
    """The slug of a tag, segment by segment."""
    return F.array_join(F.transform(F.split(tag, "/"), lambda s: F.regexp_replace(F.replace(F.replace(F.regexp_replace(s, r"\s", "-"), F.lit("&"), F.lit("-and-")), F.lit("%"), F.lit("-percent")), r"[?#]", "")), "/")
