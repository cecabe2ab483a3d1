"""DuckDB SQL with the results of the catalogue's queries, for those that SQL can express."""

from __future__ import annotations

import re

from ..sources.fixtures import DUCKDB_VIEWS

SQL: dict[str, str] = {}


def on(view: str, body: str, more: str = "") -> str:
    """A statement over one of the fixture views; ``more`` are further named subqueries."""
    views = ", ".join(f"{v} as ({DUCKDB_VIEWS[v]})" for v in view.split())
    return f"with recursive {views}{', ' + more if more else ''} {body}"


def on_shared(body: str, more: str = "") -> str:
    """A statement over the requests under five accounts, as f_requests."""
    return f"with recursive f_requests as ({DUCKDB_VIEWS['f_shared_requests']}){', ' + more if more else ''} {body}"


# ---- maps ------------------------------------------------------------------------------

SQL["binarize_count"] = on("f_pixels", "select image_id, count(*) as n from f_pixels where p >= 0.5 group by image_id")

STATS = """
ranked as (select *, row_number() over (partition by image_id order by p) - 1 as r, count(*) over (partition by image_id) as n from f_pixels),
stats as (
  select image_id, any_value(n) as n, avg(p) as mean, stddev_pop(p) as sd, max(case when r = n // 2 then p end) as median,
    max(case when r = n // 4 then p end) as p25, max(case when r = 3 * n // 4 then p end) as p75, max(case when r = 9 * n // 10 then p end) as p90,
    min(p) as least, max(p) as most, max(p) - min(p) as span, avg(case when p > 0.5 then 1.0::double else 0 end) as high
  from ranked group by image_id)"""

BIMODAL = """
h50 as (select image_id, least(floor(p * 49), 49)::int as bin, count(*) as n from f_pixels group by all),
full50 as (
  select image_id, bin, coalesce(h50.n, 0) as n, sum(coalesce(h50.n, 0)) over (partition by image_id) as total
  from (select distinct image_id from f_pixels) cross join (select unnest(range(50))::int as bin) left join h50 using (image_id, bin)),
near50 as (
  select *, lag(n) over w as before, lead(n) over w as after from full50 window w as (partition by image_id order by bin)),
peaks as (
  select image_id, count(*) filter (where bin between 1 and 48 and n > before and n > after and n > total // 100) as k from near50 group by image_id),
bim as (select image_id, case when k >= 2 then 1.0 when k = 1 then 0.5 else 0.0 end::double as bimodality from peaks)"""

SQL["prob_stats"] = on("f_pixels", "select image_id, " + ", ".join(f"round({c}, 6) as {c}" for c in ("mean", "sd", "median", "least", "most", "span", "high")) + " from stats", STATS)
SQL["histogram50"] = on("f_pixels", "select image_id, least(floor(p * 49), 49)::int as bin, count(*) as n from f_pixels group by all")
SQL["bimodality"] = on("f_pixels", "select image_id, bimodality from bim", BIMODAL)
SQL["otsu_threshold"] = on(
    "f_pixels",
    """select image_id, round(coalesce(arg_max(bin, (v, -bin)) filter (where v > 0), 0) / 255.0::double, 6) as threshold,
      round(least(coalesce(max(v), 0) / (any_value(n)::double * any_value(n)), 1.0), 6) as confidence from var group by image_id""",
    """
h as (select image_id, least(floor(p * 255), 255)::bigint as bin, count(*) as k from f_pixels group by all),
run as (
  select *, sum(k) over w as wb, sum(k * bin) over w as sb, sum(k) over (partition by image_id) as n, sum(k * bin) over (partition by image_id) as total
  from h window w as (partition by image_id order by bin)),
var as (
  select image_id, bin, n, case when n > wb then wb::double * (n - wb) * (sb / wb - (total - sb) / (n - wb)) * (sb / wb - (total - sb) / (n - wb)) else 0 end as v from run)""",
)
SQL["hist_thresholds"] = on(
    "f_pixels",
    """select image_id, round(least(greatest(db, 0), 1), 6) as db, round(least(greatest(box, 0), 1), 6) as box, round(span * (0.5 + 0.5 * bimodality), 6) as confidence
    from (select *, mean - case when bimodality > 0.7 then 0.3 when bimodality < 0.3 then 0.7 else 0.5 end::double * sd
        + case when high > 0.3 then 0.1 when high < 0.05 then -0.1 else 0 end::double as db,
      mean + case when bimodality > 0.7 then 0.3 when bimodality < 0.3 then 0.1 else 0.2 end::double * sd
        + case when high > 0.3 then 0.1 when high < 0.05 then -0.05 else 0 end::double as box
      from stats join bim using (image_id))""",
    STATS + "," + BIMODAL,
)
DYNAMIC = """
dyn as (select image_id, case when span > 0.8 then p25 + 0.3::double * (p75 - p25) else mean - 0.5::double * sd end as db,
    case when high > 0.2 then p75 else median + 0.2::double * (p90 - median) end as box, span * least(p75 - p25, 1.0::double) as confidence from stats)"""
SQL["dynamic_thresholds"] = on("f_pixels", "select image_id, round(db, 6) as db, round(box, 6) as box, round(confidence, 6) as confidence from dyn", STATS + "," + DYNAMIC)
SQL["adaptive_thresholds"] = on(
    "f_pixels",
    """select image_id, round(db, 6) as db, round(case when box < db then least(db + 0.1, 0.9) else box end, 6) as box, round(confidence, 6) as confidence, 'dynamic' as method
    from (select image_id, least(greatest(db, 0.1), 0.8)::double as db, least(greatest(box, 0.3), 0.9)::double as box, confidence from dyn)""",
    STATS + "," + DYNAMIC,
)


def _near(name: str, source: str, fold: str) -> str:
    return f"""{name} as (select a.image_id, a.y, a.x, {fold}(b.p) as p from {source} a join {source} b
      on a.image_id = b.image_id and b.y between a.y - 1 and a.y + 1 and b.x between a.x - 1 and a.x + 1 group by all)"""


for _name, _folds in {"dilate3": ["max"], "erode3": ["min"], "smooth3": ["avg"], "opening3": ["min", "max"], "closing3": ["max", "min"]}.items():
    _steps = [_near(f"s{i}", f"s{i - 1}" if i else "f_pixels", f) for i, f in enumerate(_folds)]
    SQL[_name] = on("f_pixels", f"select image_id, y, x, round(p, 6) as p from s{len(_folds) - 1}", ", ".join(_steps))

# ---- components ------------------------------------------------------------------------

LABELS = """
on_ as (select image_id, y, x, p, y * 8 + x as id from f_pixels where p >= 0.5),
reach as (
  select image_id, y, x, id as root from on_
  union
  select o.image_id, o.y, o.x, r.root from reach r join on_ o on o.image_id = r.image_id and abs(o.y - r.y) + abs(o.x - r.x) = 1),
least_ as (select image_id, y, x, min(root) as root from reach group by all),
cells as (
  select l.image_id, l.y, l.x, o.p, dense_rank() over (partition by l.image_id order by root) as label
  from least_ l join on_ o using (image_id, y, x)),
cstats as (
  select image_id, label, count(*) as n, sum(p) as sum_p, sum(p * p) as sum_sq, max(p) as max_p, min(x) as min_x, min(y) as min_y, max(x) as max_x, max(y) as max_y
  from cells group by all)"""

SQL["connected_components"] = on("f_pixels", "select image_id, y, x, label from cells", LABELS)
SQL["component_stats"] = on("f_pixels", "select image_id, label, n, round(sum_p, 6) as sum_p, round(sum_sq, 6) as sum_sq, round(max_p, 6) as max_p, min_x, min_y, max_x, max_y from cstats", LABELS)
_MEAN = "(sum_p / n)"
_VAR = f"greatest(0, sum_sq / n - {_MEAN} * {_MEAN})"
_ROOM = f"({_MEAN} * (1 - {_MEAN}))"
for _name, _value in {
    "conf_mean": _MEAN,
    "conf_max": "max_p",
    "conf_mean_var": f"{_MEAN} * (1 - 0.5 * case when {_ROOM} > 1e-6 then least(greatest({_VAR} / {_ROOM}, 0), 1) else 0 end)",
    "conf_gamma": f"pow({_MEAN}, 2)",
}.items():
    SQL[_name] = on("f_pixels", f"select image_id, label, round(least(greatest({_value}, 0), 1), 6)::double as confidence from cstats", LABELS)
BOXED = """
boxed as (select *, least(max_x + 1, 8) as bx1, least(max_y + 1, 8) as by1, sum_p / n as confidence from cstats)"""
SQL["adaptive_conf_filter"] = on(
    "f_pixels",
    """select image_id, label, round(confidence, 6) as confidence
    from (select *, (bx1 - min_x) * (by1 - min_y) / 4096.0::double as share from boxed)
    where confidence >= 0.7 * (1 - case when share < 0.01 then 0.2 * (1 - share / 0.01) else 0 end)""",
    LABELS + "," + BOXED,
)
SQL["boundary_pixels"] = on(
    "f_pixels",
    """select image_id, label, x, y from cells c where (select count(*) from cells o
      where o.image_id = c.image_id and o.label = c.label and abs(o.x - c.x) + abs(o.y - c.y) = 1) < 4""",
    LABELS,
)
SQL["detect_regions"] = on(
    "f_pixels",
    """select image_id, label, n, min_x::double as bx0, min_y::double as by0, bx1::double as bx1, by1::double as by1, round(confidence, 6) as confidence
    from boxed where confidence >= 0.7""",
    LABELS + "," + BOXED,
)

SQL["component_outlines"] = on("f_pixels", "select image_id, label, min_x::double as min_x, min_y::double as min_y, max_x::double as max_x, max_y::double as max_y from cstats", LABELS)

# ---- boxes -----------------------------------------------------------------------------


def _iou(a: str, b: str) -> str:
    w = f"(least({a}.max_x, {b}.max_x) - greatest({a}.min_x, {b}.min_x))"
    h = f"(least({a}.max_y, {b}.max_y) - greatest({a}.min_y, {b}.min_y))"
    size = lambda r: f"(({r}.max_x - {r}.min_x) * ({r}.max_y - {r}.min_y))"
    return f"case when {w} > 0 and {h} > 0 then {w} * {h} / ({size(a)} + {size(b)} - {w} * {h}) else 0 end"


SQL["pairwise_iou"] = on(
    "f_regions",
    f"""select image_id, a, b, round(iou, 6) as iou from (select a.image_id, a.region_id as a, b.region_id as b, {_iou("a", "b")} as iou
      from f_regions a join f_regions b on a.image_id = b.image_id and a.region_id < b.region_id) where iou > 0""",
)


def _nms(threshold: str) -> str:
    return on(
        "f_regions",
        """select r.image_id, r.region_id, r.confidence
        from r join (select image_id, unnest(max_by(kept, rk)) as rk from st group by image_id) using (image_id, rk)""",
        f"""
r as (select *, (max_x - min_x) * (max_y - min_y) as size, row_number() over (partition by image_id order by confidence desc, region_id) as rk from f_regions),
sup as (select b.image_id, b.rk, list(a.rk) as s from r a join r b on a.image_id = b.image_id and a.rk < b.rk where {_iou("a", "b")} > {threshold} group by all),
st as (
  select image_id, rk, [rk] as kept from r where rk = 1
  union all
  select st.image_id, r.rk, case when sup.s is not null and list_has_any(sup.s, kept) then kept else list_append(kept, r.rk) end
  from st join r on r.image_id = st.image_id and r.rk = st.rk + 1 left join sup on sup.image_id = r.image_id and sup.rk = r.rk)""",
    )


SQL["nms_hard"] = SQL["multiscale_merge"] = _nms("0.3")
SQL["nms_adaptive"] = _nms("least(greatest(0.3 + 0.1 * least(1.0, (a.size + b.size) / 2 / 10000) - 0.05 * ((a.confidence + b.confidence) / 2 - 0.5), 0.1), 0.8)")
SQL["nms_size_aware"] = _nms("0.3 + 0.1 * (greatest(0, least(1, ((a.size + b.size) / 2 - 32) / 992)) - 0.5)")


def _soft(weight: str) -> str:
    """Each step takes the best score left and lowers the others that are left; scores are lists in the order of the boxes."""
    return on(
        "f_regions",
        """select r.image_id, r.region_id, round(case when r.n > 1 and r.sure > 1 then t.score else r.confidence end, 9) as confidence
        from r join (select image_id, unnest(score) as score, generate_subscripts(score, 1) as rk from st where step = n) t using (image_id, rk)
        where r.n = 1 or (case when r.sure > 1 then t.score else r.confidence end) >= 0.1""",
        f"""
r as (
  select *, row_number() over (partition by image_id order by confidence desc, region_id) as rk, count(*) over (partition by image_id) as n,
    count(*) filter (confidence >= 0.1) over (partition by image_id) as sure from f_regions),
rows_ as (select a.image_id, a.rk, list({_iou("a", "b")} order by b.rk) as shares from r a join r b on a.image_id = b.image_id group by all),
begun as (
  select image_id, 0 as step, list(confidence order by rk) as score, list(false order by rk) as taken, list(shares order by rk) as m, count(*) as n
  from r join rows_ using (image_id, rk) group by image_id),
st as (
  select * from begun
  union all
  select image_id, step + 1, list_transform(score, lambda x, j: case when taken[j] or j = i then x else x * {weight} end), list_transform(taken, lambda t, j: t or j = i), m, n
  from (select *, list_position(left_, list_max(left_)) as i, m[list_position(left_, list_max(left_))] as share from (
    select *, list_transform(score, lambda x, j: case when taken[j] then -1 else x end) as left_ from st where step < n)))""",
    )


SQL["soft_nms_linear"] = _soft("case when share[j] >= 0.3 then 1 - share[j] else 1 end")
SQL["soft_nms_gaussian"] = _soft("exp(-share[j] * share[j] / 0.5)")
SQL["scale_regions"] = on("f_regions", "select image_id, region_id, round(min_x * 2.5, 6) as min_x, round(min_y * 1.75, 6) as min_y, round(max_x * 2.5, 6) as max_x, round(max_y * 1.75, 6) as max_y, round(confidence, 6) as confidence from f_regions")
SQL["inverse_rotation"] = on(
    "f_regions",
    """select region_id, angle, trunc(x0 + 0.5)::int as x, trunc(y0 + 0.5)::int as y, trunc(x1 - x0 + 0.5)::int as w, trunc(y1 - y0 + 0.5)::int as h from (
      select region_id, (region_id % 4 * 90)::int as angle,
        case region_id % 4 when 1 then 639 - max_y when 2 then 639 - max_x when 3 then min_y else min_x end as x0,
        case region_id % 4 when 1 then 639 - min_y when 2 then 639 - min_x when 3 then max_y else max_x end as x1,
        case region_id % 4 when 1 then min_x when 2 then 479 - max_y when 3 then 479 - max_x else min_y end as y0,
        case region_id % 4 when 1 then max_x when 2 then 479 - min_y when 3 then 479 - min_x else max_y end as y1
      from f_regions)""",
)
SQL["region_validation"] = on("f_regions", "select region_id, max_x > min_x and max_y > min_y and min_x >= 0 and min_y >= 0 and max_x <= 160 and max_y <= 96 as valid from f_regions")
SQL["crop_boxes"] = on("f_regions", "select region_id, greatest(0, least(floor(min_x)::int, 160)) as x0, greatest(0, least(floor(min_y)::int, 96)) as y0, greatest(0, least(ceil(max_x)::int, 160)) as x1, greatest(0, least(ceil(max_y)::int, 96)) as y1 from f_regions")
SQL["reading_order"] = on("f_regions", "select image_id, region_id, row_number() over (partition by image_id order by min_y, min_x, region_id)::int as ord from f_regions")
SQL["topk_regions"] = on("f_regions", "select image_id, region_id, rank::int as rank, confidence from (select *, row_number() over (partition by image_id order by confidence desc, region_id) as rank from f_regions) where rank <= 3")

# ---- sequences -------------------------------------------------------------------------

PATH = """
top_ as (select seq_id, t, max(logit) as most, sum(logit) as total, min(logit) as least from f_logits group by all),
path as (
  select l.seq_id, l.t, min(c) filter (where logit = most) as idx,
    case when any_value(total) > 0.99 and any_value(total) < 1.01 and any_value(least) >= 0 and any_value(most) <= 1 then any_value(most) else 1 / sum(exp(logit - most)) end as prob
  from f_logits l join top_ using (seq_id, t) group by l.seq_id, l.t),
out_ as (
  select * from (select *, lag(idx) over (partition by seq_id order by t) as before from path) where idx <> 0 and idx is distinct from before),
seqs as (select distinct seq_id from f_logits)"""
SQL["argmax_path"] = on("f_logits", "select seq_id, t, idx from path", PATH)
SQL["softmax_prob"] = on("f_logits", "select seq_id, t, round(prob, 6) as prob from path", PATH)
SQL["ctc_greedy"] = on("f_logits", "select seq_id, coalesce(string_agg(idx::varchar, ',' order by t), '') as classes from seqs left join out_ using (seq_id) group by seq_id", PATH)
SQL["ctc_text"] = on("f_logits f_dict", "select seq_id, coalesce(string_agg(token, '' order by t), '') as text from seqs left join out_ using (seq_id) left join f_dict d on d.idx = out_.idx - 1 group by seq_id", PATH)
SQL["sequence_confidence"] = on("f_logits", "select seq_id, round(coalesce(avg(prob), 0), 6) as confidence from seqs left join out_ using (seq_id) group by seq_id", PATH)

SQL["ctc_beam"] = on(
    "f_logits",
    """select seq_id, rk::int as rank, array_to_string(classes, ',') as classes, round(total, 6) as log_score,
      round(case when len(own) > 0 then list_sum(own) / len(own) else 0 end, 6) as confidence from st where t = 8""",
    """
sums as (select seq_id, t, sum(exp(logit)) as z from f_logits group by all),
probs as (select seq_id, t, c, exp(logit) / z as p from f_logits join sums using (seq_id, t)),
st as (
  select distinct seq_id, 0 as t, 1::bigint as rk, []::int[] as classes, 0.0::double as total, []::double[] as own, -1 as before from f_logits
  union all
  select seq_id, t, rk, classes, total, own, before from (
    select seq_id, t + 1 as t, row_number() over (partition by seq_id order by total + ln(p) desc, rk, c) as rk,
      case when c in (0, before) then classes else list_append(classes, c) end as classes, total + ln(p) as total,
      case when c in (0, before) then own else list_append(own, p) end as own, case when c in (0, before) then before else c end as before
    from (select st.*, probs.c, probs.p, max(total) over (partition by seq_id) as best from st join probs using (seq_id, t)) g
    where p > 1e-7 and total >= best - 10) w
  where rk <= 5)""",
)

# ---- text ------------------------------------------------------------------------------

EDGES = r"[\x09-\x0D\x20\x85\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{EDGES}|{EDGES}$', '', 'g')"


def _n(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


_CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]"
_CLEAN = f"regexp_replace(translate(nfc_normalize(text), chr(8203) || chr(8204) || chr(8205) || chr(65279), ''), '{_CONTROL}', '', 'g')"
for _from, _to in ((8216, "''"), (8217, "''"), (8220, '"'), (8221, '"'), (8211, "-"), (8212, "-"), (160, " "), (8201, " "), (171, '"'), (187, '"')):
    _CLEAN = f"replace({_CLEAN}, chr({_from}), '{_to}')"
_CLEAN = _trim(f"regexp_replace({_CLEAN}, '[\\x09\\x0A\\x0C\\x0D ]+', ' ', 'g')")
SQL["clean_text"] = f"select doc_id, length(t)::int as n, md5(t) as digest from (select doc_id, {_CLEAN} as t from documents)"
SQL["validate_text"] = f"select doc_id, length(text) = 0 or ({_n('text', _CONTROL)} / length(text) < 0.05 and {_n('text', r'[\p{L}\p{Nd}]')} / length(text) > 0.3) as valid from documents"
_LANGUAGE = f"""
lang_ as (
  select doc_id, lang, case when letters = 0 then '' when de > fr and de > es then 'de' when fr > de and fr > es then 'fr' when es > de and es > fr then 'es'
    when ascii * 100 // letters > 80 then 'en' else '' end as detected
  from (select doc_id, lang, {_n("text", "[äöüÄÖÜß]")} as de, {_n("text", "[èêàùçÈÀÇ]")} as fr, {_n("text", "[áíóúñÁÍÓÚÑ]")} as es,
    {_n("text", r"\p{L}")} as letters, {_n("text", "[A-Za-z]")} as ascii from documents))"""
SQL["detect_language"] = f"with {_LANGUAGE} select doc_id, detected from lang_"
SQL["language_confusion"] = f"with {_LANGUAGE} select lang, detected, count(*) as n from lang_ group by all"
SQL["charset_filter"] = f"select doc_id, {_n('text', '[abcdefß]')}::int as n from documents"


def _words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({x}), '[\x09-\x0D ]+'), lambda w: w <> '')"


def _quality(text: str) -> str:
    density = f"strlen({text}) / (612.0::double * 792.0) * 1000"
    return f"""case when regexp_replace({text}, '{EDGES}', '', 'g') = '' then 0.0 else least(1.0, 0.4::double + case when {density} > 0.1 then 0.3 else 0 end::double
      + case when len({_words(text)}) > 5 then 0.2 else 0 end::double + case when {_n(text, "[A-Za-z0-9]")} / strlen({text}) >= 0.5 then 0.1 else 0 end::double) end"""


_HAS = f"regexp_replace(text, '{EDGES}', '', 'g') <> ''"
SQL["text_quality"] = f"""select doc_id, round({_quality("text")}, 6) as score, {_HAS} as has_text, {_HAS} and len({_words("text")}) > 0 as searchable,
  round(strlen(text) / (612.0::double * 792.0) * 1000, 6) as density from documents"""
SQL["word_stats"] = f"select doc_id, len({_words('text')})::int as n_words, len(list_distinct({_words('text')}))::int as n_distinct, strlen(text)::int as n_bytes from documents"
_PAIRS = """
pairs as (select a.item_id, a.text, b.text as other from benchmark a join benchmark b on b.item_id = a.item_id + 1)"""
# This levenshtein counts bytes: the characters outside ASCII that occur stand as control characters, one each.
SQL["levenshtein_car"] = f"""with {_PAIRS},
odd as (select c, chr(13 + (row_number() over (order by c))::int) as as_ from (select distinct unnest(regexp_extract_all(lower(text), '[^\\x00-\\x7F]')) as c from benchmark)),
marks as (select coalesce(string_agg(c, '' order by c), '') as these, coalesce(string_agg(as_, '' order by c), '') as those from odd),
plain as (select item_id, translate(lower(trim(text, ' ')), these, those) as a, translate(lower(trim(other, ' ')), these, those) as b from pairs cross join marks)
select item_id, round(case when greatest(length(a), length(b)) = 0 then 1 else 1 - levenshtein(a, b) / greatest(length(a), length(b)) end, 6)::double as car from plain"""
SQL["war"] = f"""with {_PAIRS}, found as (select item_id, w, count(*) as n from (select item_id, unnest({_words("text")}) as w from pairs) group by all),
wanted as (select item_id, w, count(*) as n from (select item_id, unnest({_words("other")}) as w from pairs) group by all)
select p.item_id, round(coalesce(sum(least(wanted.n, coalesce(found.n, 0))) / sum(wanted.n), 1), 6)::double as war
from pairs p left join wanted on wanted.item_id = p.item_id left join found on found.item_id = wanted.item_id and found.w = wanted.w group by p.item_id"""
SQL["text_similarity"] = f"""with {_PAIRS} select item_id, round(case when len(x) = 0 and len(y) = 0 then 1 when len(x) = 0 or len(y) = 0 then 0
  else len(list_filter(y, lambda w: list_contains(x, w))) / (len(x) + len(y) - len(list_filter(y, lambda w: list_contains(x, w)))) end, 6)::double as similarity
from (select item_id, {_words("text")} as x, {_words("other")} as y from pairs)"""

# ---- pages -----------------------------------------------------------------------------

_ANALYSED = f"""
pages_ as (select doc_id, (doc_id % 3)::int as images, {_quality("text")} as q, {_HAS} as has_text, least(1.0, length(text) / 3000.0::double) as c from documents)"""
SQL["page_strategy"] = f"""with {_ANALYSED} select doc_id, s[1] as strategy, s[2]::double as confidence from (
  select doc_id, case when not has_text and images > 0 then ['ocr', '0.8'] when not has_text then ['skip', '0.1']
    when q >= 0.7 and c >= 0.8 and images > 0 then ['hybrid', '0.9'] when q >= 0.7 and c >= 0.8 then ['vector', '0.95']
    when q >= 0.5 and q < 0.7 and images > 0 then ['hybrid', '0.7'] when q >= 0.5 and q < 0.7 then ['vector', '0.5']
    when images > 0 then ['ocr', '0.7'] else ['vector', '0.3'] end as s from pages_)"""
SQL["ocr_benefit"] = f"with {_ANALYSED} select doc_id, round(case when images <= 0 then 0 when not has_text then 1 else greatest(0.1, ((1 - q) + (1 - c)) / 2) end, 6)::double as benefit from pages_"
SQL["text_coverage"] = on("f_elements", "select page_id, round(least(1.0, sum(w * h) / (612.0::double * 792.0)), 6) as coverage from f_elements group by page_id")
SQL["page_range_expand"] = """select id, (row_number() over (partition by id order by part, page))::int as ord, page::int as page from (
  select doc_id as id, 0 as part, unnest(range(doc_id % 5 + 1, doc_id % 5 + 2 + doc_id % 3)) as page from documents
  union all select doc_id, 1, doc_id % 7 + 1 from documents)"""
SQL["page_outer_union"] = f"""select * from (select doc_id, 1 as page, doc_id % 3 > 0 as has_images, coalesce({_HAS}, false) as analysed from documents) where has_images or analysed"""


def _merged(sep: str, least: float) -> str:
    return f"""
parts as (
  select page_id, string_agg(text, ' ' order by elem_id) filter (where source = 'vector') as own,
    string_agg(text, {sep} order by elem_id) filter (where source = 'ocr' and rec_conf >= {least}) as read_ from f_elements group by page_id),
merged as (select page_id, concat_ws({sep}, nullif(own, ''), read_) as combined, own from parts)"""


_DIGEST = "select page_id, length(combined)::int as n, md5(combined) as digest from merged"
SQL["hybrid_append"] = on("f_elements", _DIGEST, _merged("chr(10)", 0.3))
SQL["hybrid_confidence"] = on("f_elements", _DIGEST, _merged("' '", 0.5))
SQL["hybrid_quality"] = on(
    "f_elements",
    """select page_id, round(case when own_n + read_n > 0 then own_n / (own_n + read_n) else 0 end, 6)::double as vector_share,
      round(case when own_n + read_n > 0 then read_n / (own_n + read_n) else 0 end, 6)::double as ocr_share,
      round(least(1, coalesce(score * 0.6, 0) + case when regions > 0 then conf / regions * 0.4 else 0 end), 6)::double as overall,
      round(least(1, strlen(combined) / 1000.0::double), 6)::double as text_coverage,
      round(case when regions + has_ > 0 then (coalesce(score, 0) + conf) / (regions + has_) else 0 end, 6)::double as mean_confidence,
      round(case when own_n + read_n > 0 and strlen(combined) > 0 then greatest(0, 1 - strlen(combined) / (own_n + read_n)) else 0 end, 6)::double as duplication
    from sums join merged using (page_id) left join scores using (page_id)""",
    _merged("chr(10)", 0.3)
    + """,
sums as (
  select page_id, coalesce(sum(strlen(text)) filter (source = 'vector'), 0) as own_n, coalesce(sum(strlen(text)) filter (source = 'ocr'), 0) as read_n,
    coalesce(sum(rec_conf) filter (source = 'ocr'), 0) as conf, count(*) filter (source = 'ocr') as regions, max(case when source = 'vector' then 1 else 0 end) as has_
  from f_elements group by page_id),
scores as (select page_id, """
    + _quality("own")
    + " as score from merged where own is not null)",
)
SQL["element_order"] = on(
    "f_elements",
    "select page_id, elem_id, (row_number() over (partition by page_id order by line, x, y, elem_id))::int as ord from lines",
    """
jumps as (select *, case when y - lag(y) over w > lag(h) over w / 2 then 1 else 0 end as jump from f_elements window w as (partition by page_id order by y, x, elem_id)),
lines as (select *, sum(jump) over (partition by page_id order by y, x, elem_id) as line from jumps)""",
)

_LINES = """
counted as (select * from f_elements where source = 'vector' or rec_conf >= 0.3),
jumps as (select *, case when y - lag(y) over w > lag(h) over w / 2 then 1 else 0 end as jump from counted window w as (partition by page_id order by y, x, elem_id)),
lines as (select *, sum(jump) over (partition by page_id order by y, x, elem_id) as line from jumps),
placed as (select *, row_number() over (partition by page_id order by line, x, y, elem_id) as ord from lines),
st as (
  select page_id, 0::bigint as ord, []::struct(text varchar, source varchar, x double, y double, w double, h double)[] as kept from placed group by page_id
  union all
  select page_id, ord, case when hit = 0 then list_append(kept, e) when kept[hit].source = 'vector' then kept else list_transform(kept, lambda k, i: case when i = hit then e else k end) end
  from (select *, coalesce(list_position(list_transform(kept, lambda k: case when least(e.w * e.h, k.w * k.h) > 0 then
      greatest(0, least(e.x + e.w / 2, k.x + k.w / 2) - greatest(e.x - e.w / 2, k.x - k.w / 2)) * greatest(0, least(e.y + e.h / 2, k.y + k.h / 2) - greatest(e.y - e.h / 2, k.y - k.h / 2))
      / least(e.w * e.h, k.w * k.h) else 0 end > 0.1), true), 0) as hit
    from (select st.page_id, p.ord, kept, {'text': p.text, 'source': p.source, 'x': p.x, 'y': p.y, 'w': p.w, 'h': p.h} as e from st join placed p on p.page_id = st.page_id and p.ord = st.ord + 1))),
spatial as (select page_id, array_to_string(list_transform(max_by(kept, ord), lambda k: k.text), ' ') as combined from st group by page_id)"""
SQL["hybrid_spatial"] = on("f_elements", "select page_id, length(combined)::int as n, md5(combined) as digest from spatial", _LINES)
SQL["hybrid_smart"] = on(
    "f_elements",
    """select page_id, length(text)::int as n, md5(text) as digest from (
      select page_id, case when coalesce(score < 0.8, true) then array_to_string(list_concat([combined], coalesce(list_filter(extra, lambda t: not contains(lower(combined), lower(TRIM_T))), [])), ' ') else combined end as text
      from spatial left join scores using (page_id) left join more using (page_id))""".replace("TRIM_T", _trim("t")),
    _LINES
    + """,
more as (select page_id, list(text order by elem_id) as extra from f_elements where source = 'ocr' and rec_conf >= 0.5 group by page_id),
scores as (select page_id, """
    + _quality("own")
    + " as score from (select page_id, string_agg(text, ' ' order by elem_id) as own from f_elements where source = 'vector' group by page_id))",
)
SQL["fuzzy_line_dedup"] = on(
    "f_elements",
    """select page_id, elem_id, greatest(len(kept), 1)::int as n_lines, md5(array_to_string(kept, chr(10))) as digest from st where i = n""",
    f"""
cut as (select page_id, elem_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_trim("x")}), lambda x: x <> '') as ls from f_elements),
st as (
  select page_id, elem_id, ls, len(ls) as n, 0 as i, []::varchar[] as kept from cut
  union all
  select page_id, elem_id, ls, n, i + 1, case when len(list_filter(kept, lambda k: case when len(WX) = 0 and len(WK) = 0 then 1 when len(WX) = 0 or len(WK) = 0 then 0
      else len(COMMON) / (len(WX) + len(WK) - len(COMMON)) end > 0.8)) > 0 then kept else list_append(kept, ls[i + 1]) end
  from st where i < n)""".replace("COMMON", "list_filter(WK, lambda w: list_contains(WX, w))").replace("WX", _words("ls[i + 1]")).replace("WK", _words("k")),
)
SQL["region_filters"] = on(
    "f_regions",
    """select image_id, region_id, round(det_conf, 10) as det_conf, round(rec_conf, 10) as rec_conf, round(avg_det, 10) as avg_det from (
      select image_id, region_id, confidence as det_conf, (region_id * 31 % 101) / 100.0::double as rec_conf, avg(confidence) over (partition by image_id) as avg_det
      from f_regions where confidence >= 0.4) where rec_conf >= 0.5""",
)
SQL["barcode_page_box"] = on("f_regions", "select region_id, round(min_x * 0.48, 6) as px, round(792 - max_y * 0.48, 6) as py, round((max_x - min_x) * 0.48, 6) as pw, round((max_y - min_y) * 0.48, 6) as ph from f_regions")

# ---- limits ----------------------------------------------------------------------------

SQL["gap_session_counters"] = on_shared(
    """select event_id, row_number() over (partition by user_id, m order by ts, event_id)::int as minute, row_number() over (partition by user_id, hr order by ts, event_id)::int as hour,
      own_id, row_number() over (partition by own_id, own_m order by ts, event_id)::int as own_minute, row_number() over (partition by own_id, own_hr order by ts, event_id)::int as own_hour from runs""",
    """
gaps as (select *, ts - lag(ts) over (partition by user_id order by ts, event_id) as gap, ts - lag(ts) over (partition by own_id order by ts, event_id) as own_gap from f_requests),
runs as (select *, sum(case when gap >= interval 1 minute then 1 else 0 end) over w as m, sum(case when gap >= interval 1 hour then 1 else 0 end) over w as hr,
    sum(case when own_gap >= interval 1 minute then 1 else 0 end) over o as own_m, sum(case when own_gap >= interval 1 hour then 1 else 0 end) over o as own_hr
  from gaps window w as (partition by user_id order by ts, event_id), o as (partition by own_id order by ts, event_id))""",
)
_REPLAY = """
ev as (select *, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as k from f_requests),
st as (
  select user_id::bigint as user_id, 0::bigint as k, null::bigint as event_id, 0 as m, 0 as h, 0 as n, 0::bigint as b, null::bigint as last, null::bigint as day, '' as verdict, 0::bigint as wait
  from ev group by user_id
  union all
  select user_id, k, event_id, m + ok, h + ok, n + ok, b + ok * data_size, case when ok = 1 then us else last end, us // 86400000000, verdict,
    case verdict when 'ok' then 0 when 'minute' then 60000000 - gap when 'hour' then 3600000000 - gap else (us // 86400000000 + 1) * 86400000000 - us end
  from (select *, case when verdict = 'ok' then 1 else 0 end as ok from (
    select *, case when m >= 1 then 'minute' when h >= 2 then 'hour' when n >= 4 then 'requests' when b + data_size > 20000 then 'data' else 'ok' end as verdict from (
      select e.user_id, e.k, e.event_id, e.us, e.data_size, coalesce(last, us) as last, us - coalesce(last, us) as gap,
        case when us - coalesce(last, us) >= 60000000 then 0 else m end as m, case when us - coalesce(last, us) >= 3600000000 then 0 else h end as h,
        case when us // 86400000000 <> coalesce(day, us // 86400000000) then 0 else n end as n, case when us // 86400000000 <> coalesce(day, us // 86400000000) then 0 else b end as b
      from st join ev e on e.user_id = st.user_id and e.k = st.k + 1))))"""
_SHARED_REPLAY = _REPLAY.replace("m >= 1 then", "m >= 3 then").replace("h >= 2 then", "h >= 20 then").replace("n >= 4 then", "n >= 200 then").replace("> 20000 then", "> 2000000 then")
_OWN_REPLAY = re.sub(r"\b(user_id|ev|st)\b", lambda m: {"user_id": "own_id", "ev": "own_ev", "st": "own_st"}[m[0]], _REPLAY)
SQL["rate_limit_replay"] = on_shared(
    """select st.event_id, st.user_id, st.verdict, st.wait as wait_us, own_st.own_id, own_st.verdict as own_verdict, own_st.wait as own_wait_us
    from st join own_st on own_st.event_id = st.event_id where st.k > 0 and own_st.k > 0""",
    _SHARED_REPLAY + "," + _OWN_REPLAY,
)
SQL["rejections"] = on(
    "f_requests",
    """select st.event_id, st.user_id, case when verdict in ('requests', 'data') then 'quota' else 'rate' end as kind, verdict as type,
      case verdict when 'minute' then 1 when 'hour' then 2 when 'requests' then 4 else 20000 end::bigint as "limit",
      case when verdict in ('minute', 'hour') then wait end as retry_after_us,
      case when verdict in ('requests', 'data') then epoch_us(date_trunc('day', ts)) + 86400000000 end as resets_us
    from st join ev on ev.event_id = st.event_id where verdict <> 'ok' and st.k > 0""",
    _REPLAY,
)
SQL["run_statistics"] = """select count(*) as total, count(*) filter (event_id % 10 <> 0) as processed, count(*) filter (event_id % 10 = 0) as failed, 4 as workers,
  round(12.5 / count(*) filter (event_id % 10 <> 0), 6)::double as seconds_each, round(count(*) filter (event_id % 10 <> 0) / 12.5, 6)::double as per_second from events"""
SQL["stage_profile"] = on("f_requests", """select event_type, count(*) as images, sum(event_id % 9)::bigint as regions, (sum(data_size) * 1000 // 1000000)::bigint as det_ms_total, (sum(data_size) * 3001 // 1000000)::bigint as rec_ms_total,
  round(sum(data_size) * 1000 / 1000000 / count(*), 6)::double as det_ms_per_image, round(sum(data_size) * 3001 / 1000000 / count(*), 6)::double as rec_ms_per_image from f_requests group by event_type""")
SQL["quota_daily"] = on("f_requests", "select user_id, ts::date::varchar as day, count(*) as n, sum(data_size)::bigint as bytes from f_requests group by all")
SQL["request_histogram"] = on("f_requests", "select event_type, le, count(*) filter (le is null or data_size <= le) as n from f_requests cross join (select unnest([1024.0, 10240.0, 102400.0, null])::double as le) where data_size is not null group by all")
SQL["memory_average"] = on_shared(
    """select event_id, round(avg(data_size) over (partition by user_id order by ts, event_id rows between 59 preceding and current row), 6) as mean,
      max(data_size) over (partition by user_id order by ts, event_id) as peak, own_id,
      round(avg(data_size) over (partition by own_id order by ts, event_id rows between 59 preceding and current row), 6) as own_mean,
      max(data_size) over (partition by own_id order by ts, event_id) as own_peak from f_requests""",
)
SQL["batch_summary"] = on("f_requests", "select count(*) as total, count(*) filter (event_id % 10 <> 0) as done, count(*) filter (event_id % 10 = 0) as failed, round(coalesce(avg(data_size) filter (event_id % 10 <> 0), 0), 6) as mean_ms from f_requests")

# ---- geometry and images ------------------------------------------------------------------

SQL["unclip"] = on("f_regions", """select region_id, round(cx - w, 6) as min_x, round(cy - h, 6) as min_y, round(cx + w, 6) as max_x, round(cy + h, 6) as max_y
  from (select region_id, (min_x + max_x) / 2 as cx, (min_y + max_y) / 2 as cy, (max_x - min_x) * 0.75 as w, (max_y - min_y) * 0.75 as h from f_regions)""")
SQL["homography_apply"] = on("f_regions", "select region_id, round((1.25 * x + 0.5 * y - 3) / d, 6) as x, round((-0.25 * x + 1.5 * y + 2) / d, 6) as y from (select region_id, min_x as x, max_y as y, 0.0009765625 * min_x + 0.00048828125 * max_y + 1 as d from f_regions)")
SQL["rect_gate"] = on("f_pixels", "select image_id, n::int as n, round(n / 64.0::double, 6) as coverage, n / 64.0 >= 0.05 and n >= 30 as ok from (select image_id, count(*) filter (p >= 0.5) as n from f_pixels group by image_id)")
SQL["resize_dims"] = on(
    "f_regions",
    """select region_id, case when w >= 32 and h >= 32 then greatest(floor(floor(w * s) / 32) * 32, 32)::int end as to_w,
      case when w >= 32 and h >= 32 then greatest(floor(floor(h * s) / 32) * 32, 32)::int end as to_h, w < 32 or h < 32 as too_small
    from (select *, least(1.0::double, 1024 / w, 1024 / h) as s from (select region_id, (max_x * 11)::int as w, (max_y * 13)::int as h from f_regions))""",
)
SQL["recognition_dims"] = on(
    "f_regions",
    """select region_id, h > floor(w * 1.2::double)::int as turn, wide as to_w, (ceil(wide / 8) * 8)::int as padded
    from (select *, least(greatest(1, floor(w * 48 / h)::int), 320) as wide from (select region_id, (max_x - min_x)::int as w, (max_y - min_y)::int as h from f_regions))""",
)
SQL["orientation_heuristic"] = on(
    "f_pixels",
    """select image_id, case when cols > rows_ then 90 else 0 end as angle, round(case when cols + rows_ > 0 then abs(rows_ - cols) / (cols + rows_) else 0 end, 6)::double as confidence
    from (select image_id, count(*) filter (b <> r) as rows_, count(*) filter (b <> c) as cols from flips group by image_id)""",
    """
bits as (select image_id, y, x, p >= avg(p) over (partition by image_id) as b from f_pixels),
flips as (select image_id, b, lead(b) over (partition by image_id, y order by x) as r, lead(b) over (partition by image_id, x order by y) as c from bits)""",
)
SQL["map_tensor_stats"] = on("f_pixels", "select image_id, round(min(p), 6) as least, round(max(p), 6) as most, round(avg(p), 6) as mean, count(*) = 64 as valid from f_pixels group by image_id")

# ---- sinks -----------------------------------------------------------------------------

RESULTS = """
numbered as (select *, row_number() over (partition by image_id order by region_id) as ord from f_regions),
res as (
  select image_id, ord, min_x::int as x, min_y::int as y, (max_x - min_x)::int as w, (max_y - min_y)::int as h, confidence as det_conf,
    case when ord % 5 = 0 then '  ' else ' line ' || ord || case when ord % 3 = 0 then ', "quoted" ' else '' end end as text, (region_id % 8) / 8.0::double as rec_conf
  from numbered)"""
_FIELD = """case when regexp_matches(text, '[",\\r\\n]') then '"' || replace(text, '"', '""') || '"' else text end"""
SQL["csv_rows"] = on("f_regions", f"select image_id, ord::int as ord, concat_ws(',', x, y, w, h, printf('%.3f', round(det_conf::decimal(12, 6), 3)), {_FIELD}, printf('%.3f', round(rec_conf::decimal(12, 6), 3))) as line from res", RESULTS)
SQL["batch_csv_rows"] = on(
    "f_regions",
    f"""select 'img,' || image_id || '.png' as file, (ord - 1)::int as region_index,
      concat_ws(',', '"img,' || image_id || '.png"', ord - 1, {_FIELD}, printf('%.3f', round(rec_conf::decimal(12, 6), 3)), printf('%.3f', round(det_conf::decimal(12, 6), 3)), x, y, w, h, 'en') as line from res
    union all select 'img,-1.png', 0, '"img,-1.png",0,,0.000,0.000,0,0,0,0,'""",
    RESULTS,
)
SQL["json_regions"] = on("f_regions", """select image_id, '{"regions":[' || string_agg('{"ord":' || ord || ',"x":' || x || ',"y":' || y || ',"w":' || w || ',"h":' || h || ',"text":"' || replace(text, '"', '\\"') || '"}', ',' order by ord) || ']}' as json from res group by image_id""", RESULTS)
SQL["text_lines"] = on("f_regions", "select image_id, coalesce(string_agg(t, chr(10) order by ord) filter (t <> ''), '') as text from (select image_id, ord, trim(text, ' ') as t from res) group by image_id", RESULTS)

SQL["batch_widths"] = on(
    "f_regions",
    """select image_id, region_id, padded, max(padded) over (partition by image_id) as batch_w, max(padded) over (partition by image_id) - padded as fill
    from (select image_id, region_id, (ceil(least(greatest(1, floor(w * 48 / h)::int), 320) / 8) * 8)::int as padded
      from (select image_id, region_id, (max_x - min_x)::int as w, (max_y - min_y)::int as h from f_regions))""",
)
SQL["batch_text"] = on(
    "f_regions",
    """select 'img,' || image_id || '.png' as file, '# img,' || image_id || '.png' || chr(10) || coalesce(string_agg(t, chr(10) order by y, x, ord) filter (t <> ''), '') as text
    from (select image_id, ord, x, y, trim(text, ' ') as t from res) group by image_id union all select 'img,-1.png', '# img,-1.png' || chr(10)""",
    RESULTS,
)
_SHORT = "case when {0} > 0 and {0} < 0.001 then round({0} * 10000)::int || '.0E-4' else {0}::varchar end"
SQL["batch_json"] = on(
    "f_regions",
    """select 'img,' || image_id || '.png' as file, '{"file":"img,' || image_id || '.png","ocr":{"regions":[' || string_agg('{"ord":' || ord || ',"box":{"x":' || x || ',"y":' || y || ',"w":' || w || ',"h":' || h
      || '},"text":"' || replace(text, '"', '\\"') || '","rec_confidence":' || REC || ',"det_confidence":' || DET || ',"language":"en"}', ',' order by ord) || ']}}' as json from res group by image_id
    union all select 'img,-1.png', '{"file":"img,-1.png","ocr":{"regions":[]}}'""".replace("REC", _SHORT.format("rec_conf")).replace("DET", _SHORT.format("det_conf")),
    RESULTS,
)

# ---- documents -------------------------------------------------------------------------

_PAGE_TABLES = (
    _ANALYSED
    + """,
chosen as (
  select doc_id, 'doc,' || doc_id || '.pdf' as file, images as n_images, text as own, case when not has_text and images > 0 then 'ocr' when not has_text then 'skip'
    when q >= 0.7 and c >= 0.8 and images > 0 then 'hybrid' when q >= 0.7 and c >= 0.8 then 'vector' when q >= 0.5 and q < 0.7 and images > 0 then 'hybrid'
    when q >= 0.5 and q < 0.7 then 'vector' when images > 0 then 'ocr' else 'vector' end as strategy
  from pages_ join documents using (doc_id)),
pics as (
  select doc_id, file, strategy, i, (300 + doc_id % 7 * 40 + i)::int as width, (200 + doc_id % 5 * 30)::int as height, (doc_id + i) % 4 as n
  from (select *, unnest(range(1, n_images + 1)) as i from chosen) u),
regs as (
  select doc_id, file, strategy, i, ord::int as ord, (ord * 20)::int as x, (doc_id % 50 + ord)::int as y, (ord * 5 + 10)::int as w, 12 as h, (doc_id * 7 + ord * 13) % 64 / 64.0::double as conf
  from (select *, unnest(range(1, least(n, 3) + 1)) as ord from pics) u),
sizes as (
  select doc_id, max(width) as width, max(height) as height, count(*)::int as images, sum(least(n, 3))::int as regions from pics group by doc_id),
pages2 as (
  select c.doc_id, file, strategy, case when strategy in ('ocr', 'hybrid') then coalesce(width, case when strategy = 'hybrid' then 612 else 0 end) else 612 end as width,
    case when strategy in ('ocr', 'hybrid') then coalesce(height, case when strategy = 'hybrid' then 792 else 0 end) else 792 end as height,
    case when strategy in ('vector', 'hybrid') then length(own) end as own_chars,
    case when strategy in ('ocr', 'hybrid') then coalesce(images, 0) else 0 end as n_images, case when strategy in ('ocr', 'hybrid') then coalesce(regions, 0) else 0 end as n_regions
  from chosen c left join sizes using (doc_id) where strategy <> 'skip')"""
)
SQL["page_results"] = f"with {_PAGE_TABLES} select file, 1 as page, width::int as width, height::int as height, strategy, own_chars::int as own_chars, n_images::int as n_images, n_regions::int as n_regions from pages2"


def _fixed(x: str) -> str:
    return f"printf('%.3f', round(({x})::decimal(12, 6), 3))"


SQL["document_csv_rows"] = f"""with {_PAGE_TABLES} select file, 1 as page, i::int as image_index, ord, concat_ws(',', '"' || file || '"', 1, i, ord, x, y, x + w, y + h, w, h, {_fixed("conf")}) as line from regs"""
SQL["document_text"] = f"""with {_PAGE_TABLES},
rows_ as (select doc_id, i, avg(conf) as conf, count(*) as n, string_agg('    #' || ord || ' box=(' || x || ',' || y || ' ' || w || 'x' || h || ') conf=' || {_fixed("conf")} || chr(10), '' order by ord) as t from regs group by all),
imgs as (
  select p.doc_id, string_agg('  Image ' || p.i || ' (' || p.width || 'x' || p.height || '): ' || coalesce(r.n, 0) || ' region(s), confidence: ' || {_fixed("coalesce(r.conf, 0)")} || chr(10) || coalesce(t, ''), '' order by p.i) as t
  from pics p left join rows_ r using (doc_id, i) group by p.doc_id)
select file, md5(text) as digest, length(text)::int as n from (
  select file, 'File: ' || file || chr(10) || 'Total Pages: 1' || chr(10) || chr(10) || 'Page 1 (' || width || 'x' || height || '):' || chr(10)
    || case when strategy in ('ocr', 'hybrid') then coalesce(t, '') else '' end || chr(10) || '---' || chr(10) || chr(10) as text from pages2 left join imgs using (doc_id))"""

# ---- polygons --------------------------------------------------------------------------

_OUTER = (
    LABELS
    + """,
edge as (select image_id, label, x::double as x, y::double as y from cells c where (select count(*) from cells o where o.image_id = c.image_id and o.label = c.label and abs(o.x - c.x) + abs(o.y - c.y) = 1) < 4),
lists as (select image_id, label, list({'x': x, 'y': y} order by x, y) as p from edge group by all)"""
)
# Both halves of a hull: a point is put on the stack after those that turn the wrong way have been taken off, one a step.
_HULL = (
    _OUTER
    + """,
halves as (select image_id, label, 0 as side, p from lists union all select image_id, label, 1, list_reverse(p) from lists),
st as (
  select image_id, label, side, p, 1 as i, []::struct(x double, y double)[] as s from halves
  union all
  select image_id, label, side, p, case when pop then i else i + 1 end, case when pop then s[1:len(s) - 1] else list_append(s, p[i]) end
  from (select *, len(s) > 1 and (s[-1].x - s[-2].x) * (p[i].y - s[-2].y) - (s[-1].y - s[-2].y) * (p[i].x - s[-2].x) <= 0 as pop from st where i <= len(p))),
hulls as (
  select image_id, label, case when len(any_value(p)) = 1 then any_value(p) else list_concat(max(s) filter (side = 0), max(s) filter (side = 1)) end as h
  from (select image_id, label, side, p, s[1:len(s) - 1] as s from st where i > len(p)) group by image_id, label)"""
)
SQL["convex_hull"] = on(
    "f_pixels",
    "select image_id, label, len(h)::int as corners, round(abs(list_sum(list_transform(h, lambda a, i: a.x * h[i % len(h) + 1].y - h[i % len(h) + 1].x * a.y))) / 2, 6)::double as area from hulls",
    _HULL,
)
SQL["min_area_rect"] = on(
    "f_pixels",
    """select image_id, label, round(min(case when dx = 0 and dy = 0 then 0 else size / (dx * dx + dy * dy) end), 6)::double as area from (
      select image_id, label, dx, dy, (list_max(list_transform(h, lambda q: q.x * dx + q.y * dy)) - list_min(list_transform(h, lambda q: q.x * dx + q.y * dy)))
        * (list_max(list_transform(h, lambda q: q.y * dx - q.x * dy)) - list_min(list_transform(h, lambda q: q.y * dx - q.x * dy))) as size from sides) group by all""",
    _HULL
    + """,
corners as (select image_id, label, h, unnest(range(1, len(h) + 1)) as i from hulls),
sides as (select image_id, label, h, h[i % len(h) + 1].x - h[i].x as dx, h[i % len(h) + 1].y - h[i].y as dy from corners)""",
)
SQL["simplify_polygon"] = on(
    "f_pixels",
    "select image_id, label, len(p)::int as n, kept::int as kept from st where len(spans) = 0",
    _OUTER
    + """,
st as (
  select image_id, label, p, case when len(p) <= 3 then [] else [{'i': 1, 'j': len(p)}] end::struct(i bigint, j bigint)[] as spans, case when len(p) <= 3 then len(p) else 2 end as kept from lists
  union all
  select image_id, label, p, case when far then list_concat(spans[1:len(spans) - 1], [{'i': i, 'j': k}, {'i': k, 'j': j}]) else spans[1:len(spans) - 1] end, kept + far::int
  from (select *, j - i >= 2 and coalesce(list_max(away) > 1.0, false) as far, i + coalesce(list_position(away, list_max(away)), 0) as k from (
    select *, list_transform(range(i + 1, j), lambda m: case when dx = 0 and dy = 0 then sqrt((p[m].x - p[i].x) * (p[m].x - p[i].x) + (p[m].y - p[i].y) * (p[m].y - p[i].y))
      else abs(dx * (p[m].y - p[i].y) - dy * (p[m].x - p[i].x)) / sqrt(dx * dx + dy * dy) end) as away
    from (select *, p[j].x - p[i].x as dx, p[j].y - p[i].y as dy from (select *, spans[-1].i as i, spans[-1].j as j from st where len(spans) > 0)))))""",
)

# ---- PDF files ---------------------------------------------------------------------------

PDF_PAGES = """
cut as (
  select doc_id, i, (i - 1) // 50 + 1 as page, trim(regexp_replace(x, '[\\x09-\\x0D ]+', ' ', 'g'), ' ') as line
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents)),
read_back as (
  select doc_id, page::int as page, (count(*) filter (line <> ''))::int as n_rows, coalesce(string_agg(line, chr(10) order by i) filter (line <> ''), '') as text
  from cut group by doc_id, page)"""
PDF_COLUMNS = "doc_id, page, n_rows, sha256(text) as text_sha256, length(text)::int as chars, null::varchar as error"

SQL["pdf_text"] = f"with {PDF_PAGES} select {PDF_COLUMNS} from read_back"
SQL["pdf_second_pages"] = f"with {PDF_PAGES} select {PDF_COLUMNS} from read_back where page = 2"
SQL["pdf_locked"] = f"""with {PDF_PAGES} select {PDF_COLUMNS} from read_back where doc_id % 7 <> 3
union all select doc_id, null, 0, sha256(''), 0, 'wrong password' from documents where doc_id % 7 = 3"""
SQL["pdf_images"] = """
with sized as (select doc_id, encode(coalesce(text, '')) as b, greatest(1, (strlen(coalesce(text, '')) + 191) // 192) as rows_ from documents)
select doc_id, 1 as page, 'Im1' as name, 64 as width, rows_::int as height, 3 as channels, 'raw' as format,
  sha256(b || repeat('\\x00'::blob, 192 * rows_ - octet_length(b))) as data_sha256, null::varchar as error
from sized"""

SQL["barcode_values"] = """
with numbers as (select doc_id, doc_id % 4 as k, lpad(doc_id::varchar, 12, '0') as digits from documents),
sums as (select *, list_sum(list_transform(range(1, 13), lambda i: digits[i]::int * case when i % 2 = 0 then 3 else 1 end)) as s from numbers)
select doc_id, ['Code128', 'Code39', 'UPCA', 'ITF'][(k + 1)::int] as type,
  case k when 0 then 'doc-' || doc_id when 1 then 'ID ' || doc_id when 2 then digits[2:12] || ((10 - s % 10) % 10)::int else digits end as value,
  (2 * case k when 0 then 11 * (4 + length(doc_id::varchar) + 2) + 13 when 1 then 15 * (3 + length(doc_id::varchar) + 2) + 2 + length(doc_id::varchar) + 2 when 2 then 95 else 4 + 9 * 12 + 5 end)::int as length
from sums
"""

SQL["qr_values"] = """
with lists as (select doc_id // 16 as shelf, string_agg(md5(coalesce(text, ''))[1:8], '-' order by doc_id, md5(coalesce(text, ''))[1:8]) as digests from documents group by all)
select shelf::bigint as shelf, 'QR' as type, case when shelf % 2 = 0 then upper(shelf || '-' || digests) else shelf || '-' || digests end as value from lists
"""
