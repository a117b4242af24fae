"""The fact tables and scalar functions in the SQL of the check, written independently of the Spark expressions."""

from __future__ import annotations

from quarryline.functions import paths as P
from quarryline.functions.text import STOP_WORDS, SYNONYMS


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def tokens(value: str) -> str:
    stop = "[" + ",".join(map(quoted, STOP_WORDS)) + "]"
    spaced = f"lower(regexp_replace(coalesce({value}, ''), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'))"
    return f"list_sort(list_distinct(list_filter(string_split_regex({spaced}, '[^a-z0-9]+'), lambda t: length(t) >= 2 and not list_contains({stop}, t))))"


def expanded(value: str) -> str:
    table = "map {" + ",".join(f"{quoted(k)}: [{','.join(map(quoted, v.split()))}]" for k, v in SYNONYMS.items()) + "}"
    own = tokens(value)
    return f"list_sort(list_distinct(list_concat({own}, flatten(list_transform({own}, lambda t: coalesce({table}[t], []))))))[1:40]"


def matchable(value: str) -> str:
    return f"trim(regexp_replace(lower(regexp_replace(coalesce({value}, ''), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+', ' ', 'g'))"


def match_score(query: str, terms: str, value: str) -> str:
    q, v = matchable(query), matchable(value)
    hits = f"len(list_intersect({terms}, {tokens(value)}))"
    partial = f"len(list_filter({terms}, lambda t: length(t) >= 4 and contains({v}, t)))"
    return (
        f"(case when {q} = '' or {v} = '' then 0.0 when {q} = {v} then 14.0 when contains({v}, {q}) then 10.0"
        f" when {hits} > 0 then least(9.0, {hits} * 2.0 + case when {hits} = len({terms}) then 2.0 else 0.0 end) else least(6.0, {partial} * 1.5) end)"
    )


def language(path: str) -> str:
    ext = f"lower(regexp_extract({path}, '[^/\\\\.][^/\\\\]*\\.([^./\\\\]+)$', 1))"
    return "case " + " ".join(f"when {ext} in ({','.join(map(quoted, e.split()))}) then {quoted(n)}" for n, e in P.LANGUAGES.items()) + " else 'unknown' end"


def module(path: str) -> str:
    p = f"string_split({path}, '/')"
    return f"case when len({p}) <= 1 then 'root' when {p}[1] = 'web' and len({p}) > 2 then 'web/' || {p}[2] when ends_with({p}[1], '_api') then {p}[1] || '/' || {p}[2] else {p}[1] end"


def base_name(path: str) -> str:
    return f"string_split({path}, '/')[-1]"


def stem(path: str) -> str:
    return f"regexp_replace({base_name(path)}, '\\.[^.]+$', '')"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def normal(c: str) -> str:
    return rf"regexp_replace(replace({c}, '\', '/'), '^(\./+)+', '')"


def ordinal(c: str) -> str:
    return f"case {c} when 'authoritative' then 0 when 'derived' then 1 else 2 end"


FILES = f"""files as (select repo, file_path path, min(file_id) file_id, bool_or(coalesce(is_dirty, false)) dirty, max(size_bytes) size_bytes,
    {language("file_path")} lang, regexp_matches(lower(file_path), {quoted(P.TEST)}) is_test, regexp_matches(lower(file_path), {quoted(P.GENERATED)}) generated, {module("file_path")} module
    from source_files where repo is not null and file_path is not null group by repo, file_path)"""
SYMBOLS = """syms as (select * from (select symbol_id, repo, file_path path, sym_name name, qualified_name, sym_kind kind, coalesce(is_exported, false) exported, start_line, end_line,
    row_number() over (partition by symbol_id order by indexed_at desc, repo desc, file_path desc, sym_name desc, qualified_name desc, sym_kind desc, is_exported desc, start_line desc nulls last, end_line desc nulls last) rn
    from symbols where symbol_id is not null) where rn = 1)"""
EDGES = f"""edges as (select distinct edge_id, repo, edge_kind, from_path, to_path, nullif(lower({strip("from_symbol_id")}), '') from_symbol, nullif(lower({strip("to_symbol_id")}), '') to_symbol,
    confidence, coalesce(weight, 0.0) weight, fact_source from graph_edges where edge_id is not null)"""
IMPORTS = f"""imps as (select distinct import_id, repo, {normal("file_path")} path, specifier, imported_name, local_name, coalesce(is_type_only, false) type_only, coalesce(is_re_export, false) re_export,
    nullif({normal(strip("resolved_path"))}, '') resolved from import_edges where import_id is not null)"""
RISKS = """risks as (select * from (select finding_id, repo, file_path path, line_no, signal_id, category, case when isnan(score) then null else score end score, confidence, finding_ctx context,
    row_number() over (partition by finding_id order by indexed_at desc, case when isnan(score) then null else score end desc nulls last, repo desc, file_path desc, line_no desc nulls last, signal_id desc nulls last, category desc nulls last, confidence desc nulls last, fact_source desc nulls last, finding_ctx desc nulls last) rn
    from placeholder_findings where finding_id is not null and repo is not null and file_path is not null) where rn = 1)"""
TASKS = """tasks as (select * from (select task_id, repo, task_text, change_type, created_at, planned_edit_targets planned, list_transform(coalesce(focus_files, []), lambda f: f.file_path) focus,
    row_number() over (partition by task_id order by received_at desc) rn from task_snapshots where task_id is not null) where rn = 1)"""


def facts(*names: str) -> str:
    """WITH clause of the named fact tables."""
    parts = {"files": FILES, "syms": SYMBOLS, "edges": EDGES, "imps": IMPORTS, "risks": RISKS, "tasks": TASKS}
    return "with " + ",\n".join(parts[n] for n in names)


#: Test edges: a test imports a file of its repository.
TESTED = "tested as (select distinct i.repo, i.path, i.resolved target, 'authoritative' confidence from imps i join files t on t.repo = i.repo and t.path = i.path and t.is_test join files f on f.repo = i.repo and f.path = i.resolved where not i.type_only)"
#: Uses per file (calls and references out of it) and boosts of planned files, which are parts of the rank.
USED = f"""{EDGES}, used as (select repo, from_path path, count(*) n from edges where edge_kind in ('CALLS', 'REFERENCES') and from_path is not null group by all),
    boosts as (select repo, path, least(3.0, count(*) * 0.5) b from (select distinct task_id, repo, unnest(planned) path from tasks) where path is not null group by all)"""
RANKED = USED + """, parts as (select f.*, log2(coalesce(c.n, 0) + 1) centrality, least(coalesce(s.n, 0), 20) / 4 symbol_part,
    case when contains(f.path, '/api/') or contains(f.path, 'app.') or contains(f.path, 'index.') then 2.0 else 0.0 end surface,
    case when f.is_test then 0.5 when k.path is not null then 1.5 else 0.0 end near_tests, case when f.dirty then 3.0 else 0.0 end dirt,
    least(coalesce(r.s, 0.0), 12.0) risk_part, case when f.generated then -2.0 else 0.0 end made, coalesce(r.s, 0.0) risk, log2(coalesce(u.n, 0) + 1) usage, 0.0 churn, coalesce(o.b, 0.0) outcome
    from files f left join (select repo, resolved path, count(*) n from imps where resolved is not null group by all) c on c.repo = f.repo and c.path = f.path
    left join (select repo, path, count(*) n from syms group by all) s on s.repo = f.repo and s.path = f.path
    left join (select repo, path, sum(score) s from risks group by all) r on r.repo = f.repo and r.path = f.path
    left join (select distinct repo, target path from tested) k on k.repo = f.repo and k.path = f.path
    left join used u on u.repo = f.repo and u.path = f.path left join boosts o on o.repo = f.repo and o.path = f.path),
    ranked as (select *, centrality + symbol_part + surface + near_tests + dirt + risk_part + made + usage + churn + outcome as rank from parts)"""
