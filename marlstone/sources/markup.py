"""A linear tokenizer of HTML, however broken: tags and text in order, by methods named as those of Python's own parser."""

from __future__ import annotations

import re
from html import unescape

#: Elements whose content is no markup, with what ends them.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.IGNORECASE) for t in ("script", "style", "textarea", "title")}

_NAME = re.compile(r"<(/?)([A-Za-z][^\t\n\f\r />]*+)")
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\t\n\f\r >"'][^\t\n\f\r >]*+)"""
_REST = re.compile(rf"((?:[\t\n\f\r /]++|[^\t\n\f\r />=]++(?:[\t\n\f\r ]*+=[\t\n\f\r ]*+{_VALUE}?+)?+|=)*+)>")
_ATTR = re.compile(rf"([^\t\n\f\r />=]++)(?:[\t\n\f\r ]*+=[\t\n\f\r ]*+({_VALUE})?+)?+")
_COMMENT = re.compile(r"<!--(?:-?>|.*?--!?>)", re.DOTALL)
_BIG = re.compile(r"&#(?:[xX]0*+[0-9a-fA-F]{7,}|0*+[0-9]{8,});?")


def shown(s: str) -> str:
    """``s`` with character references decoded; numbers beyond any character are the replacement character."""
    return unescape(_BIG.sub("\ufffd", s)) if "&" in s else s


class Markup:
    """Override `handle_starttag`, `handle_endtag` and `handle_data`; `handle_startendtag` is both tags unless overridden."""

    def read(self, html: str) -> None:
        """Tags and text in order, in linear time; what no tag can be is text, an unfinished tag or comment at the end is none."""
        i, n, quotes, unclosed = 0, len(html), True, set()
        while i < n:
            k = html.find("<", i)
            k = n if k < 0 else k
            if k > i:
                self.handle_data(shown(html[i:k]))
            if k == n:
                return
            if not (name := _NAME.match(html, k)):
                if html.startswith("<!--", k):
                    m = _COMMENT.match(html, k)
                    i = m.end() if m else n
                elif html.startswith(("<!", "<?", "</"), k):
                    i = html.find(">", k) + 1 or n
                else:
                    self.handle_data("<")
                    i = k + 1
                continue
            rest = _REST.match(html, name.end()) if quotes else None
            if rest:
                i, attrs = rest.end(), rest[1]
            else:
                # Quotes do not match up: from here on a tag ends at the next bracket.
                i, quotes = html.find(">", name.end()) + 1 or n, False
                if html[i - 1] != ">":
                    return
                attrs = html[name.end() : i - 1]
            tag = name[2].lower()
            if name[1]:
                self.handle_endtag(tag)
                continue
            found = list(_ATTR.finditer(attrs)) if attrs else []
            given = {m[1].lower(): shown(m[2][1:-1] if (m[2] or "")[:1] in ("'", '"') else m[2] or "") for m in found}
            # A slash at the end of an unquoted value is the value's.
            if attrs.endswith("/") and not (found and found[-1].end() == len(attrs)):
                self.handle_startendtag(tag, given)
                continue
            self.handle_starttag(tag, given)
            if tag in RAW and tag not in unclosed:
                m = RAW[tag].search(html, i)
                code = tag in ("script", "style")
                if m or code:
                    end = m.start() if m else n
                    self.handle_data(html[i:end] if code else shown(html[i:end]))
                    i = end
                else:
                    unclosed.add(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)
