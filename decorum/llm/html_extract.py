"""Main text of web pages by block rules in two passes.

A page is cut into blocks at block-level tags. The first pass decides each block
by its own figures: density of stop words, length and density of links; what
lies in menus, footers, sidebars, notices, adverts, forms or comments is decided
by its container. The page itself and its article are no such containers, whatever
their names; inside them a container that is named in passing only leaves its long
blocks to their figures. A form around the whole page is none. Short and middling blocks
stay open. Neighbouring open blocks outside an article, or in a container that is named
in passing, are judged together, as one block; on pages in a language without known stop
words by links, length and ends of sentences. In the second pass an open block takes the
label of its nearest decided neighbours, those in its own section first.
"""

import html
import re
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F

#: Common words of the languages served.
STOP_WORDS = frozenset("""
the of and to in a is that it for was on with as are be this by from at an or not have has but they his her he she we you
der die das und ist ein eine zu den von mit auf für im nicht des dem sich auch es an als er sie so wie oder aus bei nach
le la les de des du un une et est en que qui dans pour sur au par pas plus ne ce il elle avec son sa ses se ou mais
el los las del y que en un una por con para es se no su al lo como más pero sus o si ya este
""".split())

#: Element names.
BLOCKS = frozenset("""
address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption
figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search
section summary table tbody td tfoot th thead tr ul
""".split())
SKIPPED = frozenset("script style noscript template svg math iframe object canvas textarea select button title audio video".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BAD_TAGS = frozenset("nav aside footer menu dialog search fieldset".split())
#: Parts of a page, which a form to fill in has not.
PARTS = frozenset("article main nav header footer h1".split())
SECTIONS = frozenset("article main section body aside nav footer".split())
#: Words in a class, id or role that name a container of anything but the article.
BAD_NAMES = frozenset("""
ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr
notice notification alert popup modal overlay newsletter subscribe signup login register paywall
nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc footer sidebar side rail widget related recommended
recommendations share sharing social follow comment comments commentlist disqus reply replies respond form search
complementary contentinfo dialog
""".split())
#: What consists of articles itself, so an article inside is none of the page.
DISCUSSION = frozenset("""
related recommended recommendations comment comments commentlist disqus reply replies respond
""".split())
#: What may as well be the subject of a part of an article.
TOPICS = frozenset("social form share sharing menu side search follow register".split())
#: With these a container of related things is a list of them; "related-work" is none.
LISTS = frozenset("""
related recommended recommendations post posts article articles story stories link links content contents news item items
list video videos product products read reading reads page pages topic topics box wrap wrapper container section widget
""".split())
#: Words in a name that tells how a page is laid out, not what a container holds.
STATES = frozenset("no not with without has open closed enabled disabled".split())
ROOTS = frozenset("html body main article".split())
HEAD_NAMES = frozenset("header masthead topbar site-header page-header".split())

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
WORD = re.compile(r"[^\W\d_]+")
#: Scripts that write a word with a sign or two.
WIDE = re.compile("[\u2e80-\ud7a3\uf900-\ufaff\U00020000-\U0003ffff]")
SENTENCE = re.compile("[.!?\u2026\u3002\uff01\uff1f\u0964\u061f\u06d4]")

GOOD, BAD, OPEN = 1, 0, None
#: How sure it is that a container holds something else than the article.
HINTED, NAMED, SURE = 1, 2, 3


class Block:
    __slots__ = ("text", "linked", "bad", "section", "inside", "heading", "form")

    def __init__(self, text, linked, element):
        self.text, self.linked, self.form = text, linked, element.form
        self.heading = element.tag in ("h2", "h3", "h4", "h5", "h6")
        self.bad, self.section, self.inside = element.bad, element.section, element.inside


class Element:
    __slots__ = ("tag", "bad", "section", "inside", "form")

    def __init__(self, tag, bad, section, inside, form):
        self.tag, self.bad, self.section, self.inside, self.form = tag, bad, section, inside, form


class Form:
    """What stands in a form: characters outside of links and containers with bad names, parts
    of a page, an article."""
    __slots__ = ("size", "parts", "article")

    def __init__(self):
        self.size, self.parts, self.article = 0, False, False


def names_bad(tag, attributes, inside):
    """How sure it is that a container holds something else than the article, or 0: SURE by
    its tag, NAMED by a whole class, id or role, HINTED by the first or last word of one."""
    if tag in BAD_TAGS or tag == "header" and not inside:
        return SURE
    if not attributes:
        return 0
    if HIDDEN.search(attributes):
        return SURE
    if tag in ROOTS:
        return 0
    level = 0
    for found in ATTRIBUTE.finditer(attributes):
        if found[1].lower() not in ("class", "id", "role"):
            continue
        for name in (found[2] or found[3] or found[4] or "").lower().split():
            parts = [x for x in re.split(r"[^a-z]+", name) if x]
            if name in HEAD_NAMES and not inside:
                level = max(level, NAMED)
            if not parts or STATES.intersection(parts):
                continue
            ends = BAD_NAMES.intersection((parts[0], parts[-1]))
            if not ends:
                continue
            if inside and ends <= TOPICS or ends <= LISTS and not LISTS.issuperset(parts):
                level = max(level, HINTED)
            else:
                level = max(level, SURE if ends & DISCUSSION else NAMED if len(parts) == 1 else HINTED)
    return level


def blocks(page):
    """Blocks of a page in order. White space inside a block is one blank, character
    references are decoded, and unfinished markup at the end is dropped. A form is no part
    of the article unless it is around the page: around its article, or around parts of the
    page and most of its text."""
    out, pieces, linked = [], [], 0
    stack = [Element("", 0, 0, False, None)]
    sections, in_link, at = 0, False, 0
    # Tags that are open, so that an end without a start does not search the stack.
    still = Counter()

    def add(raw):
        nonlocal linked
        if raw:
            pieces.append(raw)
            if in_link:
                linked += len(raw)

    def close():
        nonlocal linked
        text = " ".join(html.unescape("".join(pieces)).split())
        if text:
            out.append(Block(text, min(linked, len(text)), stack[-1]))
        pieces.clear()
        linked = 0

    size = len(page)
    while at < size:
        found = TAG.search(page, at)
        if found is None:
            add(page[at:])
            break
        add(page[at:found.start()])
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            continue
        ending, attributes = bool(found[1] or found[4]), found[3] or found[6] or ""
        if tag in SKIPPED:
            if not ending and not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
                at = size if end is None else end.start()
            continue
        if tag == "br":
            add(" ")
        elif tag == "a":
            in_link = not ending
        elif tag == "head":
            continue
        elif tag in BLOCKS:
            close()
            if ending:
                while still[tag]:
                    last = stack.pop().tag
                    still[last] -= 1
                    if last == tag:
                        break
            elif tag not in EMPTY and tag != "p":
                # Paragraphs are often left open, so they are no containers.
                top = stack[-1]
                inside = top.inside or tag in ("article", "main")
                section, form = top.section, top.form
                if form and tag in PARTS:
                    form.parts = True
                    form.article = form.article or tag in ("article", "main")
                if tag == "form" and form is None:
                    form = Form()
                # The article inside a container with a bad name is the article.
                above = 0 if top.bad < SURE and tag in ("article", "main") else top.bad
                bad = max(above, names_bad(tag, attributes, top.inside))
                if tag in SECTIONS or bad != top.bad or form is not top.form:
                    sections += 1
                    section = sections
                stack.append(Element(tag, bad, section, inside, form))
                still[tag] += 1
            if tag != "p" or not ending:
                in_link = False
    close()
    total = 0
    for block in out:
        if block.bad <= HINTED:
            total += len(block.text) - block.linked
            if block.form:
                block.form.size += len(block.text) - block.linked
    for block in out:
        form = block.form
        if form and not form.article and not (form.parts and 2 * form.size > total):
            block.bad = SURE
    return out


def stops(text):
    """(stop words, words) of a text."""
    found = WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in found), len(found)


def runs(found, wanted):
    """Lists of neighbouring blocks with a mark in ``wanted``, by place. Inside an article a
    run stays in its section."""
    out = []
    for i, mark in enumerate(wanted):
        if mark:
            joined = out and out[-1][-1] == i - 1 and (not found[i].inside or found[i].section == found[i - 1].section)
            out[-1].append(i) if joined else out.append([i])
    return out


def judge_runs(found, labels, short=70, long=200, links=0.2, high=0.15):
    """Labels after neighbouring blocks have been judged together: in containers that are named
    in passing, and on a page without a good block in an article among all blocks outside of
    containers with bad names. A run of ``long`` characters that is dense in stop words is
    good; if none is, the densest one of ``short`` characters. A page that is nowhere dense has
    a language without known stop words: there blocks that end sentences count by length."""
    plain = [b.bad <= HINTED and b.linked <= links * len(b.text) for b in found]
    hinted = [ok and b.inside and b.bad == HINTED for ok, b in zip(plain, found)]
    alone = not any(label == GOOD and b.inside or b.inside and b.bad == 0 for label, b in zip(labels, found))
    if not any(hinted) and not alone:
        return labels
    counts = [stops(b.text) if ok else (0, 0) for ok, b in zip(plain, found)]
    known = sum(c[0] for c in counts) >= high * sum(c[1] for c in counts)

    def length(i):
        return len(found[i].text) + (0 if known else 2 * len(WIDE.findall(found[i].text)))

    def size(run):
        return sum(length(i) for i in run if known or SENTENCE.search(found[i].text))

    def density(run):
        return sum(counts[i][0] for i in run) / max(sum(counts[i][1] for i in run), 1)

    out = list(labels)
    outside = [alone and ok and not b.inside and not b.bad and (not known or label is not BAD) and
               (len(b.text) >= short or not b.linked) for ok, b, label in zip(plain, found, labels)]
    for run in runs(found, hinted) + runs(found, outside):
        if size(run) >= long and (not known or density(run) >= high):
            # What is short at the ends of a container named in passing stays with its name.
            full = [i for i in run if length(i) >= short]
            first = next((i for i in run if i in full[:1] or found[i].heading or not hinted[i]), run[0])
            last = full[-1] if full and hinted[run[0]] else run[-1]
            for i in range(first, last + 1):
                out[i] = GOOD
    if alone and GOOD not in out:
        dense = [r for r in runs(found, outside) if size(r) >= short and (not known or density(r) >= high)
                 and any(SENTENCE.search(found[i].text) for i in r)]
        for i in max(dense, key=lambda r: (density(r), size(r)), default=()):
            out[i] = GOOD
    return out


def first_pass(block, short=70, long=200, links=0.2, low=0.05, high=0.15):
    """Label of a block by its own figures, or None where they leave it open."""
    if block.bad > HINTED or block.bad and not block.inside:
        return BAD
    size = len(block.text)
    if block.linked > links * size:
        return BAD
    if block.bad and size < long:
        return BAD
    if size < short:
        return OPEN if not block.linked or block.inside else BAD
    common, all_words = stops(block.text)
    density = common / max(all_words, 1)
    if density >= high and size >= long:
        return GOOD
    if block.bad:
        return BAD
    if density >= low or block.inside:
        return GOOD if block.inside and density >= low else OPEN
    return BAD


def inherit(labels, sections, inside, headings):
    """Second pass: an open block takes the label of its nearest decided neighbours in
    its section, else of the nearest ones at all. If the two sides differ, good
    wins inside an article and bad elsewhere; without any decided block it is
    good inside an article only. A subheading with nothing decided behind it in
    its section belongs to what follows that section."""
    n = len(labels)

    def nearest(same):
        before, after, last = [None] * n, [None] * n, {}
        for i in range(n):
            key = sections[i] if same else 0
            before[i] = last.get(key)
            if labels[i] is not OPEN:
                last[key] = labels[i]
        last = {}
        for i in range(n - 1, -1, -1):
            key = sections[i] if same else 0
            after[i] = last.get(key)
            if labels[i] is not OPEN:
                last[key] = labels[i]
        return before, after

    near, far = nearest(True), nearest(False)
    out = []
    for i, label in enumerate(labels):
        if label is OPEN:
            sides = {s for s in (near[0][i], near[1][i]) if s is not None}
            if headings[i] and near[1][i] is None and far[1][i] is not None:
                sides = {far[1][i]}
            if not sides and not inside[i]:
                sides = {s for s in (far[0][i], far[1][i]) if s is not None}
            label = sides.pop() if len(sides) == 1 else GOOD if inside[i] else BAD
        out.append(label)
    return out


def main_text(page):
    """The article of a page: its good blocks, joined by empty lines."""
    found = blocks(page or "")
    labels = inherit(judge_runs(found, [first_pass(b) for b in found]), [b.section for b in found],
                     [b.inside for b in found], [b.heading for b in found])
    return "\n\n".join(b.text for b, label in zip(found, labels) if label)


def extract(pages, id_col="page_id", html_col="html", keep=()):
    """One row per input row: _id, the columns in ``keep``, and _text, the main text of the
    whole page (empty if there is none). Null and empty pages have no text. Repeated
    rows are extracted each, other columns are not read, an empty table gives no rows."""
    rows = pages.select(F.col(id_col).alias("_id"), *keep, F.col(html_col).alias("_text"))

    def work(batches):
        for batch in batches:
            yield batch.assign(_text=pd.Series([main_text(p) for p in batch["_text"]], dtype=object, index=batch.index))

    return rows.mapInPandas(work, rows.schema)
