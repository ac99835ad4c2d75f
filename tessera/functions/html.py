"""HTML down to a whitelist of inline markup."""

from __future__ import annotations

from html import escape
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What stays (fixed values); elements whose content goes too; link schemes that may stay.
TAGS = ("strong", "em", "u", "a")
ATTRIBUTES = ("href", "target", "rel")
SILENT = ("script", "style", "template", "noscript", "iframe", "title", "head", "textarea", "svg", "math")
SCHEMES = ("", "http", "https", "mailto", "tel", "ftp", "sms", "callto")


class _Cleaner(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[str] = []
        self.silent: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SILENT:
            self.silent.append(tag)
        elif tag in TAGS and not self.silent:
            kept = [(k, v or "") for k, v in attrs if k in ATTRIBUTES and (k != "href" or _safe(v or ""))]
            self.out.append(f"<{tag}" + "".join(f' {k}="{escape(v)}"' for k, v in dict(reversed(kept)).items()) + ">")
            self.open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.silent:
            del self.silent[len(self.silent) - 1 - self.silent[::-1].index(tag):]
        elif tag in self.open and not self.silent:
            while True:  # elements left open inside end with it
                last = self.open.pop()
                self.out.append(f"</{last}>")
                if last == tag:
                    break

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.out.append(escape(data, quote=False))


def _safe(url: str) -> bool:
    bare = "".join(c for c in url if c > " ")
    try:
        return urlsplit(bare).scheme.lower() in SCHEMES
    except ValueError:
        return False


def clean(html: str | None) -> str | None:
    """Markup with strong, em, u and a alone; text of other elements stays, that of scripts and styles goes."""
    if html is None:
        return None
    parser = _Cleaner()
    parser.feed(html)
    parser.close()
    return "".join(parser.out) + "".join(f"</{t}>" for t in reversed(parser.open))


@F.pandas_udf(StringType())
def sanitized(html: pd.Series) -> pd.Series:
    return html.map(clean, na_action="ignore")
