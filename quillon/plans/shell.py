"""The engine at a prompt."""

from __future__ import annotations

import cmd

from pyspark.sql import functions as F

from quillon.operators.skills import markdown
from quillon.plans.engine import Engine


class Shell(cmd.Cmd):
    """Books, runs, skills, search and export of one store; ``help`` lists the commands."""

    prompt = "quillon> "

    def __init__(self, engine: Engine, folder: str, **streams):
        super().__init__(**streams)
        self.use_rawinput = not streams
        self.engine, self.folder = engine, folder
        engine.progress = self._tell

    def _tell(self, *words: object) -> None:
        print(*words, file=self.stdout, flush=True)

    def _rows(self, df, most: int = 30) -> None:
        rows = df.limit(most).collect()
        for r in rows:
            self._tell(*["" if v is None else v for v in r])
        self._tell(f"({len(rows)})")

    def do_books(self, line: str) -> None:
        """Files of the folder."""
        self._rows(self.engine.list_books(self.folder).select("file_name", "format", "size_mb"))

    def do_run(self, line: str) -> None:
        """Process new files; "run full" processes all."""
        self._tell(self.engine.run(self.folder, incremental=line.strip() != "full").count(), "skills")

    def do_skills(self, line: str) -> None:
        """Skills, of a category if one is named."""
        self._rows(self.engine.list_skills(category=line.strip()).select("id", "name", "category", "status", "quality_score"))

    def do_search(self, line: str) -> None:
        """Skills with all the words."""
        self._rows(self.engine.search(line))

    def do_similar(self, line: str) -> None:
        """Chunks and skills whose vectors are nearest to a text."""
        self._rows(self.engine.similar_to(line))

    def do_show(self, line: str) -> None:
        """One skill, by id, as a document."""
        current = self.engine.skills.current()
        found = current.where(F.col("id") == line.strip()).select(markdown(current)).first()
        self._tell(found[0] if found else "no such skill")

    def do_stats(self, line: str) -> None:
        """Totals, and skills by category."""
        for k, v in self.engine.stats().first().asDict().items():
            self._tell(f"{k}: {v}")
        self._rows(self.engine.histogram("category"))

    def do_export(self, line: str) -> None:
        """Write all skills as documents to a folder."""
        self._tell(self.engine.export_markdown(line.strip(), 60), "files")

    def do_quit(self, line: str) -> bool:
        """Leave."""
        return True

    do_EOF = do_quit

    def emptyline(self) -> None:
        pass
