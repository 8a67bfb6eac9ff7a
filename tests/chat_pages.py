"""A chat service on a folder, for tests: pages of its messages, and a file that counts the pages that were asked for."""

import json
import os
import uuid

from corpusmill.sources.chat import Page

SIZE = 10


class FolderChat:
    def __init__(self, folder):
        self.folder = folder

    def page(self, chat, cursor):
        open(os.path.join(self.folder, f"asked-{chat}-{uuid.uuid4().hex}"), "w").close()
        with open(os.path.join(self.folder, f"{chat}.json")) as file:
            items = json.load(file)  # newest first
        at = int(cursor or 0)
        more = at + SIZE < len(items)
        return Page(items[at : at + SIZE], more, str(at + SIZE) if more and chat != "broken" else None)


def asked(folder, chat):
    return sum(name.startswith(f"asked-{chat}-") for name in os.listdir(folder))
