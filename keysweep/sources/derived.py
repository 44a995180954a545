"""Input tables derived from the given parquet tables.

Each derived column is one SQL expression that Spark (``F.expr``) and the DuckDB
oracle both evaluate, so the two engines see identical inputs.  ``dialect`` only
switches the handful of functions whose names differ.  All derivations are
narrow projections over the scans: the work grows with the tables.
"""

from __future__ import annotations

from keysweep import catalog as C


def _bigint_len_bytes(col: str, dialect: str) -> str:
    return f"cast(octet_length({col}) as bigint)" if dialect == "spark" else f"cast(strlen({col}) as bigint)"


# FIXTURES.md seeding: the documents' text plus known secrets keyed on doc_id.
SEEDED_TEXT = """concat_ws(chr(10), text,
  case when doc_id % 5  = 0 then concat('id AKIA', upper(substr(md5(cast(doc_id as string)),1,16))) else '' end,
  case when doc_id % 7  = 0 then concat('use ghp_', md5(cast(doc_id as string)), '0a1b') else '' end,
  case when doc_id % 11 = 0 then concat('db postgres://app:', substr(md5(cast(doc_id as string)),1,12), '@db.internal/main') else '' end,
  case when doc_id % 13 = 0 then concat('bot xoxb-', substr(md5(cast(doc_id as string)),1,24)) else '' end,
  case when doc_id % 17 = 0 then concat('pay sk_live_', substr(md5(cast(doc_id as string)),1,24)) else '' end,
  case when doc_id % 19 = 0 then 'password = "example-password"' else '' end,
  case when doc_id % 23 = 0 then concat('-----BEGIN RSA PRIVATE KEY-----', chr(10), md5(cast(doc_id as string)), chr(10), '-----END RSA PRIVATE KEY-----') else '' end)"""

REPO_OF_DOC = "concat('org/r', cast(cast(floor(doc_id/2) as bigint) as string))"

# Paths that exercise the file filters: binary suffixes, skipped directories as
# first and inner segment, and look-alikes that must be kept.
DOC_PATH_VARIANT = """case doc_id % 8
  when 1 then concat('assets/', cast(doc_id as string), '.PNG')
  when 3 then concat('dist/', cast(doc_id as string), '.js')
  when 5 then concat('web/node_modules/lib/', cast(doc_id as string), '.js')
  when 6 then concat('Dist/', cast(doc_id as string), '.png.txt')
  when 7 then concat('builds/', cast(doc_id as string), '.md')
  else concat('src/', cast(doc_id as string), '.txt') end"""

PAGE_TEXT = ("replace(replace(replace(replace(replace(html, '&quot;', '\"'), '&#39;', ''''), "
             "'&lt;', '<'), '&gt;', '>'), '&amp;', '&')")
PAGE_REPO = "concat('web/', regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1))"


def seeded_documents_sql(dialect: str) -> str:
    """files(repository, branch, path, content, size) from documents, path = doc_id.txt."""
    return (f"select {REPO_OF_DOC} as repository, 'main' as branch, "
            f"concat(cast(doc_id as string), '.txt') as path, content, "
            f"{_bigint_len_bytes('content', dialect)} as size "
            f"from (select doc_id, {SEEDED_TEXT} as content from {{documents}}) d")


def repo_files_sql(dialect: str) -> str:
    """files from documents (varied paths), pages (entities unescaped) and conversations."""
    size = _bigint_len_bytes("content", dialect)
    return f"""select repository, branch, path, content, {size} as size from (
  select {REPO_OF_DOC} as repository, 'main' as branch, {DOC_PATH_VARIANT} as path,
         {SEEDED_TEXT} as content from {{documents}}
  union all
  select {PAGE_REPO} as repository, 'main' as branch,
         concat('pages/', cast(page_id as string), '.html') as path, {PAGE_TEXT} as content from {{pages}}
  union all
  select concat('chat/c', cast(conv_id as string)) as repository, 'main' as branch,
         concat('turns/', cast(turn as string), '-', role, '.txt') as path, text as content from {{conversations}}
) f"""


def files_encoded_sql(dialect: str) -> str:
    """files_encoded: the seeded documents as base64 blobs (what a content API returns)."""
    b64 = "base64(encode(content, 'UTF-8'))" if dialect == "spark" else "to_base64(encode(content))"
    return (f"select repository, branch, path, {b64} as content_b64, size "
            f"from ({seeded_documents_sql(dialect)}) s")


def scan_requests_sql(dialect: str) -> str:
    """scan_requests(request_id, owner, repo, branch, path) with invalid rows by modulus."""
    return f"""select doc_id as request_id,
  case doc_id % 10 when 0 then '-org' when 1 then 'org-' when 2 then repeat('o', 101)
       when 3 then 'a' when 4 then 'a-b' when 5 then '' when 6 then null else 'org' end as owner,
  case doc_id % 9 when 0 then concat('r', cast(doc_id as string), '!') when 1 then ''
       when 2 then repeat('r', 100) else concat('r', cast(cast(floor(doc_id/2) as bigint) as string)) end as repo,
  case doc_id % 7 when 0 then null when 1 then '' when 2 then 'feature/x-1' when 3 then 'bad branch'
       when 4 then repeat('b', 256) else 'main' end as branch,
  case doc_id % 11 when 0 then repeat('p', 1001) when 1 then null when 2 then ''
       when 3 then repeat('p', 1000) else concat(cast(doc_id as string), '.txt') end as path
from {{documents}}"""


def snippets_sql(dialect: str) -> str:
    """snippets(snippet_id, code, path) from conversation turns."""
    return f"""select conv_id * 100 + turn as snippet_id,
  case when turn = 0 and conv_id % 13 = 0 then ''
       when turn = 1 and conv_id % 5 = 0 then concat(text, chr(10), 'token = ', md5(cast(conv_id as string)))
       when turn = 2 and conv_id % 3 = 0 then concat('key: ghp_', md5(cast(conv_id as string)), '0a1b', chr(10), text)
       when turn = 3 and conv_id % 2 = 0 then concat('# api_key = ', md5(cast(conv_id as string)), chr(10),
                                               '  // xoxb-', substr(md5(cast(turn as string)), 1, 16), chr(10), text)
       else text end as code,
  case turn % 4 when 0 then null when 1 then '' when 2 then repeat('s', 1001)
       else concat('snips/', cast(conv_id as string), '.py') end as path
from {{conversations}}"""


def secret_requests_sql(dialect: str) -> str:
    """secret_requests(request_id, secret_type, value): pairs to validate offline."""
    return f"""select doc_id as request_id,
  case doc_id % 6 when 0 then 'aws_access_key_id' when 1 then 'github_token' when 2 then 'stripe_live_key'
       when 3 then 'no_such_type' when 4 then '' else 'slack_token' end as secret_type,
  case doc_id % 5 when 0 then concat('AKIA', upper(substr(md5(cast(doc_id as string)),1,16)))
       when 1 then concat('ghp_', md5(cast(doc_id as string)), '0a1b')
       when 2 then 'example-placeholder-value'
       when 3 then repeat('v', 10001)
       else concat('sk_live_', substr(md5(cast(doc_id as string)),1,24)) end as value
from {{documents}}"""


def log_entries_sql(dialect: str) -> str:
    """log_entries(event_id, timestamp, level, message, context MAP, error STRUCT) from events."""
    if dialect == "spark":
        ctx = ("map_from_arrays(array('user', 'apiKey', 'props', 'monkey', 'note', 'secretsFound'), "
               "array(cast(user_id as string), substr(md5(cast(event_id as string)), 1, cast(event_id % 13 as int)), props, "
               "'zzz', concat('pwd: ', md5(cast(event_id as string))), cast(event_id % 4 as string)))")
        err = ("case when event_type = 'error' then named_struct('name', 'Error', 'message', "
               "concat('upstream rejected AKIA', upper(substr(md5(cast(event_id as string)),1,16))), "
               "'stack', concat('Error: upstream', chr(10), '    at call (client.js:', cast(event_id % 97 as string), ':7)')) end")
    else:
        ctx = ("map(['user', 'apiKey', 'props', 'monkey', 'note', 'secretsFound'], "
               "[cast(user_id as string), substr(md5(cast(event_id as string)), 1, cast(event_id % 13 as int)), props, "
               "'zzz', concat('pwd: ', md5(cast(event_id as string))), cast(event_id % 4 as string)])")
        err = ("case when event_type = 'error' then struct_pack(name := 'Error', message := "
               "concat('upstream rejected AKIA', upper(substr(md5(cast(event_id as string)),1,16))), "
               "stack := concat('Error: upstream', chr(10), '    at call (client.js:', cast(event_id % 97 as string), ':7)')) end")
    return f"""select event_id, ts as timestamp,
  case event_type when 'error' then 'ERROR' when 'view' then 'DEBUG' when 'click' then 'INFO'
       when 'signup' then 'INFO' else 'WARN' end as level,
  concat('user ', cast(user_id as string), ' ', event_type,
         case event_id % 4 when 0 then concat(' token=', md5(cast(event_id as string)))
              when 1 then concat(' key: ghp_', md5(cast(event_id as string)), '0a1b')
              when 2 then concat(' via xoxb-', substr(md5(cast(event_id as string)), 1, 20))
              else '' end) as message,
  {ctx} as context,
  {err} as error
from {{events}}"""


def raw_names_sql(dialect: str) -> str:
    """raw_names(doc_id, name): user-typed names with padding and control characters."""
    return f"""select doc_id, concat(
  case doc_id % 4 when 0 then ' ' when 1 then '\u00a0\t' when 2 then '\ufeff' else '' end,
  source, case doc_id % 3 when 0 then chr(0) when 1 then chr(11) else chr(9) end, lang,
  case doc_id % 5 when 0 then chr(127) when 1 then chr(13) when 2 then chr(31) else '' end,
  case doc_id % 2 when 0 then ' \u3000' else chr(10) end) as name
from {{documents}}"""


def key_files_sql(dialect: str) -> str:
    """files whose private-key blocks have all kinds of labels, and ends without a beginning, beginnings without an end and
    blocks within blocks by modulus."""
    label = ("case doc_id % 6 when 0 then 'RSA ' when 1 then 'EC ' when 2 then '' when 3 then 'ANY ' when 4 then 'SSH2 ENCRYPTED ' "
             "else 'OPENSSH ' end")
    begin, end = (f"concat('-----{x} ', {label}, 'PRIVATE KEY-----')" for x in ("BEGIN", "END"))
    body = "concat(md5(cast(doc_id as string)), chr(10), md5(text))"
    return f"""select {REPO_OF_DOC} as repository, 'main' as branch, concat('keys/', cast(doc_id as string), '.pem') as path, content,
  {_bigint_len_bytes('content', dialect)} as size from (select doc_id, concat_ws(chr(10), substr(text, 1, cast(doc_id % 300 as int)),
  case when doc_id % 11 = 3 then concat('stray ', {end}) else '' end,
  case when doc_id % 3 = 0 then concat('key = ', {begin}, chr(10), {body}, chr(13), chr(10), {end}, ' tail') else '' end,
  case when doc_id % 7 = 1 then concat({begin}, chr(10), 'inner -----BEGIN X PRIVATE KEY-----', chr(10), {body}) else '' end,
  case when doc_id % 5 = 2 then concat('one line ', {begin}, ' ', md5(text), ' ', {end}, ' and ', {begin}, chr(10), 'x', {end}) else '' end,
  case when doc_id % 13 = 4 then concat('id AKIA', upper(substr(md5(cast(doc_id as string)),1,16)), ' ', {begin}) else '' end) as content
  from {{documents}}) d"""


def file_versions_sql(dialect: str) -> str:
    """file_versions(repository, branch, path, version, content): the seeded documents, some of which come twice, change, lose
    their secrets or go."""
    return f"""select {REPO_OF_DOC} as repository, 'main' as branch, concat(cast(doc_id as string), '.txt') as path,
  cast(v as bigint) as version, case when v = 1 or doc_id % 6 = 1 then content
    when doc_id % 4 = 0 then concat(content, chr(10), 'id AKIA', upper(substr(md5(content), 1, 16)))
    when doc_id % 4 = 1 then 'nothing here' when doc_id % 4 = 2 then null else content end as content
from (select doc_id, {SEEDED_TEXT} as content, {"explode(array(1, 2, 1))" if dialect == "spark" else "unnest([1, 2, 1])"} as v
      from {{documents}}) d where v = 1 or doc_id % 3 = 0"""


def token_files_sql(dialect: str) -> str:
    """files with one token a line, of which some can't be what they look like: wrong alphabets and checksums, payloads that don't
    decode, values of little variety or filled in elsewhere."""
    b64 = (lambda x: f"replace(base64(encode({x}, 'UTF-8')), concat(chr(13), chr(10)), '')") if dialect == "spark" else (lambda x: f"to_base64(encode({x}))")
    url = lambda x: f"replace(translate({b64(x)}, '+/', '-_'), '=', '')"
    m = "md5(cast(doc_id as string))"
    return f"""select {REPO_OF_DOC} as repository, 'main' as branch, concat(cast(doc_id as string), '.env') as path, content,
  {_bigint_len_bytes('content', dialect)} as size from (select doc_id, concat_ws(chr(10), substr(text, 1, 80),
  concat('id AKIA', case when doc_id % 2 = 0 then translate(upper(substr({m}, 1, 16)), '0189', 'WXYZ') else upper(substr({m}, 1, 16)) end),
  concat('bot xoxb-', case when doc_id % 3 = 0 then repeat('1', 20) else substr({m}, 1, 20) end),
  concat('db postgres://app:', case doc_id % 4 when 0 then concat(chr(36), '{{{{DB_PASS}}}}') when 1 then 'password' else substr({m}, 1, 9) end, '@db.internal/main'),
  concat('jwt ', case when doc_id % 5 = 0 then 'eyJ' || {m} else {url("""concat('{{{{"alg":"HS256","kid":"', cast(doc_id as string), '"}}}}')""")} end, '.',
         {url("""concat('{{{{"sub":"', cast(doc_id as string), '"}}}}')""")}, '.', {m}),
  concat('password = ', case doc_id % 6 when 0 then '"changeme"' when 1 then 'aaaaaaaab' when 2 then '<your-password>' else substr({m}, 3, 14) end),
  concat('AccountKey=', substr({b64(f"concat({m}, md5(text))")}, 1, 85), case when doc_id % 2 = 0 then 'A==' else 'B==' end),
  concat('use ghp_', {m}, '0a1b')) as content from {{documents}}) d"""


def code_files_sql(dialect: str) -> str:
    """files of several languages with keys in code, in strings, in comments over several lines and behind markers in strings."""
    key = "concat('AKIA', upper(substr(md5(cast(doc_id as string)), 1, 16)))"
    n = "chr(10)"
    return f"""select {REPO_OF_DOC} as repository, 'main' as branch, concat('src/', cast(doc_id as string), case doc_id % 6
    when 0 then '.js' when 1 then '.py' when 2 then '.sql' when 3 then '.html' when 4 then '.JAVA' else '.txt' end) as path, content,
  {_bigint_len_bytes('content', dialect)} as size from (select doc_id, concat(
  substr(text, 1, cast(doc_id % 120 as int)), {n},
  '/* begin ', {key}, {n}, ' still ', {key}, ' */ x = "', {key}, '"', {n},
  'url = "https://h/', {key}, '" // tail ', {key}, {n},
  's = "a /* no comment ', {key}, '"; t = ', chr(39), 'it ', chr(92), chr(39), ' -- # ', {key}, chr(39), {n},
  '# hash ', {key}, {n}, '-- dash ', {key}, {n},
  '<!-- ', {key}, {n}, {key}, ' --> after ', {key}, {n},
  case when doc_id % 5 = 0 then concat('/* never closed ', {key}) else concat('end ', {key}) end) as content from {{documents}}) d"""


def overlap_files_sql(dialect: str) -> str:
    """files with secrets that several rules match: tokens that are assigned, in addresses and behind other names."""
    m = "md5(cast(doc_id as string))"
    return f"""select {REPO_OF_DOC} as repository, 'main' as branch, concat(cast(doc_id as string), '.cfg') as path, content,
  {_bigint_len_bytes('content', dialect)} as size from (select doc_id, concat_ws(chr(10), substr(text, 1, 60),
  concat('token = ghp_', {m}, '0a1b'), concat('plain ghp_', {m}, '0a1b and key: ', {m}),
  case when doc_id % 2 = 0 then concat('access_token=', {m}, ' secret=AKIA', upper(substr({m}, 1, 16))) else '' end,
  case when doc_id % 3 = 0 then concat('Authorization: Bearer eyJ', {m}, '.eyJ', {m}, '.', {m}) else '' end,
  case when doc_id % 5 = 0 then concat('password = postgres://app:', {m}, '@db/token=', {m}) else '' end,
  case when doc_id % 7 = 0 then concat('twitter_secret_key: ', substr({m}, 1, 30), ' pwd=xoxb-', {m}) else '' end) as content
  from {{documents}}) d"""


SQL_BUILDERS = {
    "overlap_files": overlap_files_sql,
    "code_files": code_files_sql,
    "token_files": token_files_sql,
    "file_versions": file_versions_sql,
    "key_files": key_files_sql,
    "raw_names": raw_names_sql,
    "seeded_documents": seeded_documents_sql,
    "repo_files": repo_files_sql,
    "files_encoded": files_encoded_sql,
    "scan_requests": scan_requests_sql,
    "snippets": snippets_sql,
    "secret_requests": secret_requests_sql,
    "log_entries": log_entries_sql,
}

assert C.DEFAULT_BRANCH == "main"


TABLE_NAMES = ["documents", "pages", "conversations", "events"]


def duckdb_sql(name: str) -> str:
    """The derived table as DuckDB SQL over the pre-registered views."""
    return SQL_BUILDERS[name]("duckdb").format(**{t: t for t in TABLE_NAMES})


def spark_sql_text(name: str) -> str:
    return SQL_BUILDERS[name]("spark")
