"""Command line: run, books, skills, search, similar, stats, settings, export, delete, clear and serve on one store."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillon import __version__
from quillon.operators import models, providers
from quillon.operators.skills import markdown
from quillon.plans import report
from quillon.plans.engine import STAGES, Engine, Settings
from quillon.plans.service import Api, server
from quillon.plans.shell import Shell
from quillon.sources import texts


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quillon", description=__doc__)
    parser.add_argument("--store", required=True, help="folder of the stores, shared by driver and executors")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="process the files of a folder")
    run.add_argument("folder")
    run.add_argument("--full", action="store_true", help="process finished files again")
    run.add_argument("--strategy", default="semantic", choices=["semantic", "hybrid", "paragraph", "recursive", "fixed_size"])
    run.add_argument("--provider", default="", help="a model service, by name")
    run.add_argument("--extractor", default="direct", choices=["direct", "ocr", "hybrid"])
    run.add_argument("--skip-on-error", action="store_true", help="leave out a failing stage that only changes rows")
    commands.add_parser("file", help="process one file").add_argument("path")
    staged = commands.add_parser("stage", help="run the stages up to one, and show what it makes")
    staged.add_argument("folder")
    staged.add_argument("name", choices=STAGES)
    flow = commands.add_parser("workflow", help="write an n8n workflow that starts runs")
    flow.add_argument("folder")
    flow.add_argument("out")
    commands.add_parser("show").add_argument("id")
    commands.add_parser("errors", help="files that could not be read")
    commands.add_parser("shell", help="commands at a prompt").add_argument("folder")
    commands.add_parser("version")
    commands.add_parser("books").add_argument("folder")
    listed = commands.add_parser("skills")
    for name in ("category", "status"):
        listed.add_argument(f"--{name}", default="")
    listed.add_argument("--tag", action="append")
    for name in ("search", "similar"):
        found = commands.add_parser(name)
        found.add_argument("text")
        found.add_argument("--limit", type=int, default=10)
    commands.add_parser("stats")
    commands.add_parser("settings")
    served = commands.add_parser("serve", help="answer HTTP requests; runs process the given folder")
    served.add_argument("folder")
    served.add_argument("--port", type=int, default=8000)
    commands.add_parser("export").add_argument("folder")
    commands.add_parser("delete").add_argument("id")
    commands.add_parser("clear", help="forget cached vectors and finished work")
    a = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("quillon").getOrCreate()
    settings = Settings(strategy=a.strategy, provider=a.provider, extractor=a.extractor) if a.command == "run" else Settings()
    if settings.provider in providers.SERVICES and settings.provider not in models.PROVIDERS:
        providers.connect(settings.provider)
    engine = Engine(spark, a.store, settings, progress=lambda stage: print(stage, flush=True))
    if a.command == "run":
        print(engine.run(a.folder, incremental=not a.full, skip_on_error=a.skip_on_error).count(), "skills")
    elif a.command == "file":
        print(engine.run_file(a.path).count(), "skills")
    elif a.command == "stage":
        engine.run_stage(a.folder, a.name).show(20)
    elif a.command == "workflow":
        texts.write_json(a.out, report.workflow(a.store, a.folder))
    elif a.command == "show":
        engine.skills.current().where(F.col("id") == a.id).select(markdown(engine.skills.current()).alias("markdown")).show(1, truncate=False)
    elif a.command == "errors":
        engine.errors.current().show(50, truncate=False)
    elif a.command == "shell":
        Shell(engine, a.folder).cmdloop()
    elif a.command == "version":
        print(__version__)
    elif a.command == "books":
        engine.list_books(a.folder).show(truncate=False)
    elif a.command == "skills":
        engine.list_skills(a.category, a.status, a.tag).select("id", "name", "category", "status", "quality_score").show(50, truncate=False)
    elif a.command == "search":
        engine.search(a.text, a.limit).show(a.limit, truncate=False)
    elif a.command == "similar":
        engine.similar_to(a.text, a.limit).show(a.limit, truncate=False)
    elif a.command == "stats":
        engine.stats().show()
    elif a.command == "settings":
        engine.settings_table().show(50, truncate=False)
    elif a.command == "serve":
        server(Api(engine, a.folder), a.port).serve_forever()
    elif a.command == "export":
        print(engine.export_markdown(a.folder), "files")
    elif a.command == "delete":
        print(engine.skills.delete(F.col("id") == a.id), "deleted")
    else:
        engine.embeddings.clear()
        engine.ledger.clear()


if __name__ == "__main__":
    main()
