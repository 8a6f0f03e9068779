"""HTML to text and links: small per-page helpers for mapInPandas."""

from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

from tidelog import fixed_values as V

# Elements that never hold content (fixed values of the HTML standard).
_VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
}
_ROOTS = ["main", "article", "content", "body"]  # in order of preference


class _TextParser(HTMLParser):
    """Collects the stripped strings below the first element of every root kind."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str | None]] = []  # (tag, root kind opened here)
        self.dropped = 0
        self.active: set[str] = set()
        self.strings: dict[str, list[str]] = {}
        self.pending = ""

    def _flush(self):
        text, self.pending = self.pending.strip(), ""
        if text and not self.dropped:
            for kind in self.active:
                self.strings[kind].append(text)

    def handle_starttag(self, tag, attrs):
        self._flush()
        if tag in _VOID:
            return
        kind = tag if tag in _ROOTS else None
        if tag == "div" and "content" in (dict(attrs).get("class") or "").split():
            kind = "content"
        if self.dropped or kind in self.strings:
            kind = None
        if kind:
            self.active.add(kind)
            self.strings[kind] = []
        self.open.append((tag, kind))
        self.dropped += tag in V.DROPPED_TAGS

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._flush()
        if all(name != tag for name, _ in self.open):
            return
        name = None
        while name != tag:
            name, kind = self.open.pop()
            self.dropped -= name in V.DROPPED_TAGS
            self.active.discard(kind)

    def handle_data(self, data):
        self.pending += data

    def handle_comment(self, data):
        self._flush()


def page_text(html: str | None) -> str:
    """Newline-joined strings of main, else article, else div.content, else body; "" on bad input."""
    try:
        parser = _TextParser()
        parser.feed(html or "")
        parser.close()
        parser._flush()
    except Exception:
        return ""
    for kind in _ROOTS:
        if kind in parser.strings:
            return "\n".join(parser.strings[kind])
    return ""


class _LinkParser(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []

    def handle_starttag(self, tag, attrs):
        href = dict(attrs).get("href")
        if tag == "a" and href is not None:
            self.found.append(href)


def page_links(url: str, html: str | None) -> list[str]:
    """Absolute links to the same host, in page order; five file suffixes are left out."""
    parser = _LinkParser()
    try:
        parser.feed(html or "")
        parser.close()
        host = urlparse(url).netloc
    except Exception:
        return []
    links = []
    for href in parser.found:
        try:
            link = urljoin(url, href)
            same_host = urlparse(link).netloc == host
        except ValueError:
            continue
        if same_host and not link.endswith(tuple(V.DROPPED_LINK_SUFFIXES)):
            links.append(link)
    return links
