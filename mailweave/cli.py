"""python -m mailweave.cli --input-dir mails --output-dir out --format all"""

from __future__ import annotations

import argparse
import os

from mailweave.plans.analyze import analyze, ordered
from mailweave.session import local_session
from mailweave.sinks.reports import SINKS, write_report
from mailweave.sources.config import load_config
from mailweave.sources.crm import connect, read_crm
from mailweave.sources.mailfiles import read_mail_files


def main(args: list[str] | None = None) -> list[str]:
    p = argparse.ArgumentParser(description="Report on the mails of a folder or a CRM record")
    p.add_argument("--input-dir", "-i", help="folder with .msg and .eml files")
    p.add_argument("--output-dir", "-o", default="out")
    p.add_argument("--format", "-f", default="all", choices=[*SINKS, "all"])
    p.add_argument("--config", "-c")
    p.add_argument("--extractor", default="regex", choices=["regex", "hybrid"])
    p.add_argument("--sf-case", help="number of a case in the CRM")
    p.add_argument("--sf-opportunity", help="name of an opportunity in the CRM")
    a = p.parse_args(args)
    if not (a.input_dir or a.sf_case or a.sf_opportunity):
        p.error("one of --input-dir, --sf-case and --sf-opportunity is needed")
    spark, config = local_session("mailweave"), load_config(a.config)
    sources = []
    if a.input_dir:
        read = read_mail_files(spark, a.input_dir, "msg", "PERMISSIVE").unionByName(read_mail_files(spark, a.input_dir, "eml", "PERMISSIVE"))
        for r in read.where("error IS NOT NULL").select("source_file", "error").toLocalIterator():
            print(f"{r['source_file']} is left out: {r['error']}")
        sources.append(read.where("error IS NULL"))
    if a.sf_case or a.sf_opportunity:
        client = connect(config)
        for name, by in ((a.sf_case, "case"), (a.sf_opportunity, "opportunity")):
            if client and name:
                sources.append(read_crm(spark, client, name, by))
    mails = None
    for s in sources:  # sources have the columns they have
        mails = s if mails is None else mails.unionByName(s, allowMissingColumns=True)
    if mails is None or mails.isEmpty():
        print("no mails found")
        return []
    sections = analyze(ordered(mails), config, extractor=a.extractor)
    os.makedirs(a.output_dir, exist_ok=True)
    sections.pop("Mails")
    return write_report(a.output_dir, sections, a.format)


if __name__ == "__main__":
    print("\n".join(main()))
