"""The rules of SURVEY §2, stated one script at a time in plain Python, for brute-force comparison."""

import re
from collections import Counter

from lineweave import fixed_values as fv

MARK = re.compile(r"\{[^}]+\}")


def upper_any(line, tokens):
    return any(t in line.upper() for t in tokens)


def clean(lines):
    for line in lines:
        if re.match(r"\s*(#|--)", line):
            continue
        if re.match(r"\s*spark\.sql", line):
            line = line.partition("#")[0]
        line = re.sub(r"/\*.*?\*/", "", line.partition("--")[0])
        if not any(t in line for t in fv.BOILERPLATE_TOKENS):
            yield line


def variables(lines):
    found = {}
    for line in lines:
        if line.count("=") != 1 or "\\" in line or upper_any(line, fv.NOT_ASSIGNMENT_TOKENS):
            continue
        left, right = line.split("=")
        name = left.strip().replace("{", "").strip()
        for t in ('f"', "f'", '"', "'"):
            right = right.replace(t, "")
        value = right.strip()
        if "." in value and "/" in value:
            for t in fv.VALUE_PREFIXES:
                value = value.replace(t, "")
        elif "." in value:
            value = value.split(".")[1]
        value = value.replace("{", "").replace("}", "")
        if "DB" in name and "_" in value:
            value = "IP_PLF" if "IP_" in value else value.split("_")[0]
        found[name] = value
    return found


def substitute(lines, names):
    def second_part(m):
        return "{%s}" % m.group().split(".")[1].replace("}", "")

    def value(m):
        mark = m.group()
        hit = next((k for k in names if k in mark), None)
        if hit is None:
            return mark
        return "{%s%s}" % (names[hit], "_" + mark.split(".")[-1] if "." in mark else "")

    for line in lines:
        if re.search(r"\{[\w.]+\}\.\{?\w+\}?", line):
            line = re.sub(r"\{[^}]+\.\w+\}", second_part, line)
        line = MARK.sub(value, line)
        for t in fv.CONFIG_PREFIXES:
            line = line.replace(t, "")
        line = line.replace("\t", "    ").rstrip()
        if line.strip() and not upper_any(line, fv.JOB_CONTROL_TOKENS):
            yield line


def assemble(lines):
    joined, head = [], ""
    for line in lines:
        if line.endswith("\\"):
            head += line[:-1].strip() + (" " if "=" in line else "")
            continue
        joined.append(head + line.strip() if head else line)
        head = ""
    value = ""
    for line in joined:
        sets = "save_dir" in line and "=" in line
        if sets:
            value = "save_dir-" + line.split("=")[1].strip()
            continue
        yield line.replace("save_dir", value) if line.startswith("df_") and ".write" in line else line


def kind_of(line):
    u = line.upper()
    rules = [
        ("VIEW", "CREATE OR REPLACE" in u and "VIEW" in u),
        ("CREATE", "CREATE " in u and "TABLE " in u), ("DROP", "DROP " in u), ("ALTER", "ALTER " in u),
        ("INSERTINTO", "INSERTINTO" in u), ("INSERT", "INSERT " in u), ("FROM", "FROM " in u),
        ("JOIN", "JOIN " in u), ("SAVE", "SAVE_DIR" in u or ".SAVE" in u),
        ("LOCATION", "LOCATION " in u and "_LOCATION" not in u), ("READ_PARQUET", "read.parquet" in line),
        ("TEMP_VIEW", "CREATEORREPLACETEMPVIEW" in u), ("DF_UNION", ".UNION(" in u),
        ("WRITE_MODE", ".WRITE.MODE(" in u),
    ]
    held = [name for name, holds in rules if holds]
    if held:
        return held[-1]
    return "ETC" if re.search(r"\w+\}?\.\w+", line) else None


def bare(name):
    return re.sub(r"['\"{}()]", "", name).upper()


def normal(name):
    name = bare(name)
    if "." not in name:
        return name
    schema, table = name.split(".")[:2]
    return ("IP_PLF" if "IP_PLF" in schema else schema.split("_")[0]) + "." + table


def passes(name, line, schemas):
    parts = name.split(".")
    schema = re.sub("^DB_", "", parts[0])
    if len(name) <= 2 or re.search("[가-힣]", schema) or (len(parts) > 1 and len(parts[1]) < 3):
        return False
    if "(" + name in line or "CASE WHEN " + name in line.upper():
        return False
    if any(schema.startswith(p) for p in fv.REJECTED_SCHEMA_PREFIXES):
        return False
    schema = "IP_PLF" if "IP_PLF" in schema else schema.split("_")[0]
    return any(schema.startswith(s) and schema.endswith(s) for s in schemas)


def owners(lines):
    """(line number, owner) per line, None as owner where the script fails."""
    label, owned, opened, in_sql = "None", False, 0, False
    for n, line in enumerate(lines, 1):
        if line.lstrip().startswith("df_") and any(t in line for t in fv.OPENING_TOKENS):
            m = re.search(r"df_[^\s.=]+", line)
            if not m:
                yield n, None
                return
            label, opened, owned = m.group(), n, True
        in_sql = in_sql or "spark.sql(" in line
        if not owned and not (in_sql and "None" in label):
            label = f"None_{n}"
        if '""")' in line and in_sql:
            label, owned, in_sql = "#", False, False
        yield n, label
        if owned and "createOrReplaceTempView" in line:
            label = f"None_{opened}"


def program_map(lines, schemas=tuple(fv.KNOWN_SCHEMAS)):
    """Counter of (line number, owner, kind, table, in line, line)."""
    lines = list(clean(lines))
    lines = list(assemble(substitute(lines, variables(lines))))
    rows, views, carried = Counter(), [], []
    try:
        for (n, owner), line in zip(owners(lines), lines):
            if owner is None:
                break
            kind = kind_of(line)
            if "CREATEORREPLACETEMPVIEW" in line.upper():
                views.append(bare(line.split("(")[1]))
            if kind is None:
                continue
            if kind == "WRITE_MODE":
                carried = re.findall(r"/\w+\S+[\"|']", line)
            elif kind in ("SAVE", "READ_PARQUET"):
                carried = re.findall(r"\w+}/\w+", line)
            elif kind == "ETC":
                carried = re.findall(r"\w+\}?\.\w+", line)
            else:
                carried = re.findall(r"\{?[\w.]+\}?\.\{?\w+\}?", line.replace("spark.sql", "")) or carried
            if kind != "TEMP_VIEW":
                used = [f"TEMPVIEW.{v}" for v in views if v in line.upper()]
                carried = carried + used
                kind = "TEMP_VIEW_USE" if used else kind
            if kind in ("TEMP_VIEW", "DF_UNION"):
                carried = [line.split("(")[1]]
            elif kind in ("SAVE", "READ_PARQUET"):
                carried = [carried[0].replace("/", ".")]
            elif kind == "WRITE_MODE":
                carried = [carried[0].split("/")[1] + "." + carried[0].split("/")[2]]
            carried = [normal(c) for c in carried]
            if kind not in ("TEMP_VIEW", "DF_UNION", "SAVE", "READ_PARQUET", "WRITE_MODE"):
                carried = [c for c in carried if passes(c, line, schemas)]
            for name in carried:
                if "TEMP_VIEW" in kind and "." in name:
                    name = name.split(".")[1]
                rows[(n, owner, kind, name, name in line.replace("}", "").upper(), line)] += 1
    except IndexError:
        pass
    return rows
