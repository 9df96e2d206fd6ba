"""Truth in YAML, read entry by entry: of the list `findings` only a few entries exist as Python objects at once."""

from __future__ import annotations

from collections.abc import Callable

import yaml
from yaml.composer import Composer
from yaml.constructor import SafeConstructor
from yaml.resolver import Resolver

STRING, LIST = "tag:yaml.org,2002:str", "tag:yaml.org,2002:seq"

if yaml.__with_libyaml__:

    class Loader(Composer, yaml.cyaml.CParser, SafeConstructor, Resolver):
        """libyaml's events under the composer in Python."""

        def __init__(self, stream: str):
            yaml.cyaml.CParser.__init__(self, stream)
            Composer.__init__(self)
            SafeConstructor.__init__(self)
            Resolver.__init__(self)

else:
    Loader = yaml.SafeLoader


class Reader(Loader):
    """The items of the top mapping's list `findings` go to `sink` as they come, and the list is left empty; `begin` is
    called before the first one. Where anchors stand before it, the list is read like all else."""

    def __init__(self, text: str, begin: Callable[[], None], sink: Callable[[object], None]):
        super().__init__(text)
        self.begin, self.sink, self.level, self.streamed = begin, sink, 0, False

    def compose_node(self, parent: yaml.Node | None, index: object) -> yaml.Node:
        if self.level == 1 and isinstance(index, yaml.ScalarNode) and (index.tag, index.value) == (STRING, "findings"):
            self.streamed = self.check_event(yaml.SequenceStartEvent) and not self.anchors and self.peek_event().anchor is None and self.peek_event().tag is None
            if self.streamed:  # of a name that stands twice the last counts
                return self.items()
        self.level += 1
        try:
            return super().compose_node(parent, index)
        finally:
            self.level -= 1

    def items(self) -> yaml.Node:
        self.begin()
        start = self.get_event()
        self.level += 1
        while not self.check_event(yaml.SequenceEndEvent):
            self.sink(self.construct_document(super().compose_node(None, None)))
        self.level -= 1
        return yaml.SequenceNode(LIST, [], start.start_mark, self.get_event().end_mark)


def load(text: str, begin: Callable[[], None], sink: Callable[[object], None]) -> object:
    """What yaml.safe_load gives, but for the items of `findings`, which sink got: all of them after the last begin(). A
    list that wasn't read so is passed on from the mapping."""
    reader = Reader(text, begin, sink)
    try:
        doc = reader.get_single_data()
    finally:
        reader.dispose()
    if not reader.streamed:
        begin()
        for item in doc["findings"] if isinstance(doc, dict) and isinstance(doc.get("findings"), list) else ():
            sink(item)
    return doc
