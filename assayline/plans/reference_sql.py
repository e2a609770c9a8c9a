"""DuckDB SQL for every registered query, written verb by verb over the lab tables.

Unlike the Spark plans these queries join first and aggregate last, on full rows.
"""

from __future__ import annotations

import re

from assayline.plans import lab_views as lv


def _select(binding: dict[str, str], source: str, distinct: bool = False) -> str:
    return f"select {'distinct ' if distinct else ''}{', '.join(lv.columns(binding))} from {source}"


_BASE = {
    "country": _select(lv.COUNTRY, "nation"),
    "odd_texts": _select(lv.ODD_TEXTS, "supplier"),
    "site": _select(lv.SITE, "supplier"),
    "instrument_master": _select(lv.INSTRUMENT_MASTER, "part"),
    "test_type": _select(lv.TEST_TYPE, "orders", distinct=True),
    "test": _select(lv.TEST, "orders"),
    "test_activity_abbott": _select(lv.ACTIVITY_ABBOTT, "lineitem join orders on l_orderkey = o_orderkey"),
    "test_activity_roche": _select(lv.ACTIVITY_ROCHE, "orders"),
    "error_type": " union all ".join(
        [
            _select(lv.ERROR_TYPE_PLATES, "lineitem where l_linenumber < 7", distinct=True),
            _select(lv.ERROR_TYPE_TESTS, "customer", distinct=True),
            *[f"select '{c}', '{n}', '{d}', {s}" for c, n, d, s in lv.ERROR_TYPE_ROWS],
        ]
    ),
    "kit_error_codes": _select(lv.KIT_ERROR_CODES, "lineitem where l_linenumber in (1,2,5)", distinct=True),
    "place_candidates": _select(lv.PLACE_CANDIDATES, "supplier cross join region where r_regionkey < s_suppkey % 3"),
    "supplier_geo": _select(lv.SUPPLIER_GEO, "supplier"),
    "active_locations": _select(lv.ACTIVE_LOCATIONS, f"supplier where {lv.ACTIVE_LOCATIONS_ROWS}"),
    "datim_lab_sites": _select(lv.DATIM_LAB_SITES, "customer"),
}

_SAME = "is not distinct from"
_ASCII_MODEL = (
    "lower(trim(regexp_replace(replace(regexp_replace(instrument_model, '[^\\x00-\\x7F]', '', 'g'), ',', ' '), '\\s+', ' ', 'g')))"
)
_CODE_TEXT = (
    "case when error_type_id = floor(error_type_id) then cast(cast(error_type_id as bigint) as varchar)"
    " else cast(error_type_id as varchar) end"
)


def _nearest_month(d: str) -> str:
    this = f"cast(date_trunc('month', {d}) as date)"
    following = f"cast(date_trunc('month', {d}) + interval 1 month as date)"
    return f"case when {following} - {d} <= {d} - {this} then {following} else {this} end"


def _label(x: str) -> str:
    """Two significant digits, half to even, in the shorter of fixed and scientific notation."""
    return f"""(select case when v = 0 then '0%' when length(fixed) <= length(sci) then fixed || '%' else sci || '%' end
      from (select v,
        case when e < 0 then '0.' || repeat('0', -e - 1) || (case when m % 10 = 0 then m // 10 else m end)
             when e = 0 then case when m % 10 = 0 then cast(m // 10 as varchar) else (m // 10) || '.' || (m % 10) end
             else cast(cast(m * pow(10.0, e - 1) as bigint) as varchar) end fixed,
        (m // 10) || (case when m % 10 = 0 then '' else '.' || (m % 10) end) || 'e' || (case when e < 0 then '-' else '+' end)
          || lpad(cast(abs(e) as varchar), 2, '0') sci
      from (select v, case when r = 100 then 10 else r end m, case when r = 100 then e0 + 1 else e0 end e
      from (select v, e0, cast(round_even(case when e0 < 1 then v * pow(10.0, 1 - e0) else v / pow(10.0, e0 - 1) end, 0) as integer) r
      from (select v, cast(floor(log10(abs(case when v = 0 then 1 else v end))) as integer) e0 from (select cast({x} as double) v))))))"""


def _monthly_rate(slots: str) -> str:
    """Codes per month in these slots, as a percentage of 15 slots per test."""
    return f"""select c.*, t.tests, c.n * 100 / t.tests error_percent from
      (select country_code, instrument_model, "month", error_code_list, count(*) n from {slots} group by all) c
      left join (select country_code, instrument_model, "month", count(*) filter (where slot < 15) tests
       from {slots} group by all) t
      on c.country_code {_SAME} t.country_code and c.instrument_model {_SAME} t.instrument_model
      and c."month" {_SAME} t."month" where c.error_code_list is not null"""


_SHARED = {
    "models_upper": "select try_cast(instrument_id as bigint) instrument_id, replace(upper(instrument_model), '®', '')"
    " instrument_model, supplier_site_id from instrument_master",
    "models_ascii": f"select instrument_id, {_ASCII_MODEL} instrument_model, supplier_site_id from instrument_master",
    "abbott": f"select a.*, m.instrument_model, m.supplier_site_id from test_activity_abbott a"
    f" left join models_upper m on a.instrument_id {_SAME} m.instrument_id",
    "tas_clean": f"""select a.*, tt.test_type_psm, strftime(a.test_date, '%m-%Y') test_month_year,
      nullif(regexp_extract(test_record_id, '\\|(\\d+)$', 1), '') well_number,
      regexp_replace(test_record_id, '\\|\\d+$', '') plate_id, {_CODE_TEXT} code, s.supplier_site_name
      from abbott a left join test_type tt on a.test_type_id {_SAME} tt.test_type_id
      left join site s on a.supplier_site_id {_SAME} s.supplier_site_id
      where tt.test_type_psm in ('EID', 'EID/VL', 'VL')""",
    "affected": """select test_month_year, code error_type_id, instrument_model, instrument_id, supplier_site_name, country_code,
      count(*) plates_affected from (select distinct plate_id, test_month_year, instrument_model, instrument_id,
      supplier_site_name, country_code, code from tas_clean where error_count > 0) group by all""",
    "total": """select test_month_year, country_code, supplier_site_name, instrument_model, instrument_id, count(*) plates
      from (select distinct test_month_year, country_code, supplier_site_name, instrument_model, instrument_id, plate_id
      from tas_clean) group by all""",
    "roche": f"select a.*, m.instrument_model, m.supplier_site_id from test_activity_roche a"
    f" left join models_upper m on a.instrument_id {_SAME} m.instrument_id",
    "roche_caps": f"select a.*, upper(m.instrument_model) instrument_model, m.supplier_site_id from test_activity_roche a"
    f" left join instrument_master m on a.instrument_id {_SAME} m.instrument_id",
    "code_slots": f"""select r.* exclude (error_code_list, codes), codes[slot + 1] error_code_list,
      {_nearest_month('test_date')} "month" from (select r.*, string_split(error_code_list, ',') codes,
      unnest(range(greatest(15, coalesce(len(string_split(error_code_list, ',')), 0)))) slot from roche_caps r) r""",
    "family_slots": "select * from code_slots where contains(instrument_model, '00')",
    "monthly": _monthly_rate("family_slots"),
    "cuts": """select distinct cut from (select unnest(quantile_disc(tot_patient_test, [i / 8 for i in range(1, 8)])) + 1 cut from test)
      where cut > (select min(tot_patient_test) from test)""",
    "site_monthly": f"""select c.*, t.tests, c.n * 100 / t.tests percent from
      (select country_code, supplier_site_id, "month", error_code_list, count(*) n from family_slots
       where error_code_list is not null group by all) c
      left join (select country_code, supplier_site_id, "month", count(*) filter (where slot < 15) tests
       from family_slots group by all) t
      on c.country_code {_SAME} t.country_code and c.supplier_site_id {_SAME} t.supplier_site_id
      and c."month" {_SAME} t."month" """,
    "recent": "select * from site_monthly where \"month\" > date '2000-11-01' and country_code <> 'C3'",
    "top_errors": """select country_code, error_code_list from (select country_code, error_code_list,
      rank() over (partition by country_code order by peak desc) r from
      (select country_code, error_code_list, max(error_percent) peak from monthly where country_code <> 'C3' group by all))
      where r <= 3""",
    "long_slots": """select r.* exclude (error_code_list, codes), codes[slot + 1] error_code_list
      from (select r.*, string_split(error_code_list, ',') codes,
      unnest(range(greatest(1, coalesce(len(string_split(error_code_list, ',')), 0)))) slot from roche r) r
      where contains(instrument_model, '00')""",
    "second": f"""select 'INTERNAL-' || cast(record_key as varchar) internal_id, case when slot < 9 then
      substr('abcdefghi', cast(slot + 1 as integer), 1) else cast(slot + 1 as varchar) end "name",
      l.error_code_list, case when l.error_code_list = '6282.36' then
      'Pipetted volume was not sufficient. Sample was not transferred' else e.error_type_description end error_type_description,
      instrument_id, instrument_model, l.supplier_site_id, s.supplier_site_name, l.country_code, test_type_id, test_date,
      is_patient_test, is_control_test, patient_test_error_flag, control_test_error_flag, excluded_test,
      strftime(test_date, '%b %Y') test_month_year from long_slots l
      left join (select error_type_id, error_type_description from error_type where supplier_id = 1000) e
        on l.error_code_list {_SAME} e.error_type_id
      left join site s on l.supplier_site_id {_SAME} s.supplier_site_id
      where slot = 0 or l.error_code_list is not null
      qualify row_number() over (partition by record_key, l.error_code_list order by slot) = 1""",
    "one_per_test": "select * from second qualify row_number() over (partition by internal_id order by \"name\") = 1",
    "kit_base": f"""select a.*, m.instrument_model, m.supplier_site_id, c.country_name from models_ascii m
      left join site s on m.supplier_site_id {_SAME} s.supplier_site_id
      left join country c on s.country_code {_SAME} c.country_code
      right join test_activity_abbott a on a.instrument_id {_SAME} m.instrument_id
      where m.instrument_model = 'm2000rt'""",
    "kit_log": f"""select b.instrument_id, instrument_model, supplier_site_id, country_name, test_record_id, test_type_id,
      error_type_id, error_count, test_date, is_patient_test, is_control_test, patient_test_error_flag,
      control_test_error_flag, excluded_tests, category_message, possible_issue, protocol
      from kit_base b left join kit_error_codes k on b.error_type_id {_SAME} k.error_code
      where error_type_id in (select error_code from kit_error_codes)""",
    "plate_state": """select country_name, plate, case when count(*) filter (where error_type_id in (4442, 4457, 4458, 4441)) > 0
      then 'affected' else 'non-affected' end control_errors from
      (select country_name, error_type_id, concat(split_part(test_record_id, '|', 1), ' ', split_part(test_record_id, '|', 2), ' ',
      split_part(test_record_id, '|', 3), ' ', split_part(test_record_id, '|', 4)) plate from kit_base) group by all""",
    "df_tests": f"""select t.instrument_id, m.supplier_site_id, c.country_name, t.test_id, t.test_type_id, tt.test_type, t.test_date,
      t.tot_patient_test, t.tot_patient_error from instrument_master m
      left join site s on m.supplier_site_id {_SAME} s.supplier_site_id
      right join test t on m.instrument_id {_SAME} t.instrument_id
      left join test_type tt on t.test_type_id {_SAME} tt.test_type_id
      left join country c on s.country_code {_SAME} c.country_code
      where t.test_date > date '2001-08-01' - interval 12 month""",
    "df_sites_inst": """select country_name,
      cast(count(distinct supplier_site_id) + max(case when supplier_site_id is null then 1 else 0 end) as bigint) "Total sites",
      cast(count(distinct instrument_id) + max(case when instrument_id is null then 1 else 0 end) as bigint) "Total instruments"
      from df_tests group by country_name""",
    "df_instruments": f"""select t.instrument_id, m.instrument_model, s.supplier_name, m.supplier_site_id, s.supplier_site_name,
      s.supplier_id supplier_id_x, c.country_name, t.test_type_id,
      cast(year(t.test_date) as varchar) || ' Q' || cast(quarter(t.test_date) as varchar) quarter_year
      from models_ascii m left join site s on m.supplier_site_id {_SAME} s.supplier_site_id
      right join test t on m.instrument_id {_SAME} t.instrument_id
      left join country c on s.country_code {_SAME} c.country_code where t.test_date > date '2000-07-01'""",
    "queries_text": f"""select s.supplier_site_id, s.supplier_site_name, s.city, s.country_code, c.country_name,
      trim(regexp_replace(regexp_replace(coalesce(s.supplier_site_name, 'NA') || ' ' || coalesce(s.city, 'NA') || ' '
      || coalesce(c.country_name, 'NA'), '[^\\x00-\\x7F]', '', 'g'), '\\s+', ' ', 'g')) site_name_city_country
      from site s left join country c on s.country_code {_SAME} c.country_code""",
    "labs": "select * from datim_lab_sites where countryname in ("
    + ", ".join(f"'NATION_{i}'" for i in range(1, 8))
    + ")",
    "sites": "select * from supplier_geo where supplier_site_id in (select supplier_site_id from active_locations)",
}
_CTES = {**_BASE, **_SHARED}


def _with(body: str) -> str:
    """``body`` preceded by the definitions it mentions, directly or through others."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in _CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(_CTES[name])

    visit(body)
    if not needed:
        return body
    return "with " + ",\n".join(f"{n} as ({_CTES[n]})" for n in _CTES if n in needed) + "\n" + body


_TYPES = ("HIGH", "LOW", "MEDIUM", "NOT SPECIFIED", "URGENT")
_QUARTERS = ("2000 Q3", "2000 Q4", "2001 Q1", "2001 Q2", "2001 Q3")


def _country_by_type(value: str) -> str:
    cells = ", ".join(f"max(case when test_type = '{t}' then v end) \"{t}\"" for t in _TYPES)
    return f"""select w.*, d."Total sites", d."Total instruments" from
      (select country_name "Country", {cells} from (select country_name, test_type, {value} v from df_tests group by all)
       group by country_name) w left join df_sites_inst d on w."Country" {_SAME} d.country_name"""


def _sum_na(x: str) -> str:
    return f"case when count(*) = count({x}) then cast(sum({x}) as bigint) end"


_SAMPLE = _country_by_type(_sum_na("tot_patient_test"))
_ERRORS = _country_by_type(_sum_na("tot_patient_error"))
_SHARE = _country_by_type(
    f"cast({_sum_na('tot_patient_error')} as double) / nullif({_sum_na('tot_patient_test')}, 0)"
)


def _short_number(c: str) -> str:
    q = f'cast("{c}" as double)'
    steps = " ".join(f"when abs({q}) >= {size} then format('{{:,.2f}}', {q} / {size}) || '{s}'" for size, s in
                     (("1e12", "T"), ("1e9", "B"), ("1e6", "M"), ("1e3", "K")))
    return f"coalesce(case {steps} else format('{{:,.2f}}', {q}) end, '—') \"{c}\""


def _quarter_counts(keys: str) -> str:
    cells = ", ".join(f"max(case when quarter_year = '{q}' then n end) \"{q}\"" for q in _QUARTERS)
    return f"""select {keys}, {cells} from (select {keys}, quarter_year, count(*) n from
      (select distinct {keys}, quarter_year, instrument_id from df_instruments) group by all) group by {keys}"""


def _top5(by: str, source: str = "code_slots") -> str:
    part = f"partition by {by} " if by else ""
    cols = f"{by}, " if by else ""
    return f"""select {cols}error_code_list, n from (select *, rank() over ({part}order by n desc) r from
      (select {cols}error_code_list, count(*) n from {source} where error_code_list is not null group by all)) where r <= 5"""


def _top5_series(by: str, plot: str) -> str:
    return f"""select {by}, error_code_list, n, row_number() over (partition by {by} order by mean desc, error_code_list) display_rank
      from (select *, avg(n) over (partition by {plot}error_code_list) mean from ({_top5(by)}))"""


def _rate(by: str, tests_by: str, keep: str) -> str:
    on = " and ".join(f"c.{k} {_SAME} t.{k}" for k in tests_by.split(", "))
    return f"""select {keep}, error_code_list, error_type_description, n, tests_run, n * 100 / tests_run error_percent from
      (select {by}, error_code_list, error_type_description, count(*) n from second where error_code_list is not null group by all) c
      left join (select {tests_by}, count(*) tests_run from one_per_test group by all) t using ({tests_by})""".replace(
        f"using ({tests_by})", f"on {on}"
    ).replace(f"select {keep}", "select " + ", ".join(f"c.{k}" for k in keep.split(", ")), 1)


def _plates_at(level: tuple[str, ...]) -> dict[str, str]:
    keys = ", ".join(level)
    a = f"select {keys}, error_type_id, cast(sum(plates_affected) as bigint) plates_affected from affected group by all"
    t = f"select {keys}, cast(sum(plates) as bigint) plates from total group by all"
    on = " and ".join(f"a.{k} {_SAME} t.{k}" for k in level)
    p = f"select a.*, t.plates, a.plates_affected * 100 / t.plates percent from ({a}) a left join ({t}) t on {on}"
    return {"affected_plates": a, "total_plates": t, "percent_plates": p}


_LEVELS = {
    "my": ("test_month_year",),
    "my_country": ("test_month_year", "country_code"),
    "my_country_site": ("test_month_year", "country_code", "supplier_site_name"),
}
_BARS = f'cast("month" + 14 as date) x, {_label("error_percent")} "label"'
_ERROR_COUNTRY = """select country_code, "month", error_code_list, cast(sum(n) as bigint) n, cast(sum(tests) as bigint) tests,
      sum(n) * 100 / sum(tests) error_percent from monthly group by all"""
_SITE_CODE = """select supplier_site_id, error_code_list, cast(sum(n) as bigint) n, cast(sum(tests) as bigint) tests,
      sum(n) * 100 / sum(tests) percent from recent where supplier_site_id is not null group by all"""
_HAVERSINE = """2 * 6378137.0 * asin(least(1.0, sqrt(
      pow(sin(radians((latitude - candidate_lat) / 2)), 2)
      + cos(radians(candidate_lat)) * cos(radians(latitude)) * pow(sin(radians((longitude - candidate_lon) / 2)), 2))))"""


def _error_country(extra: str) -> str:
    return f"""select *, {_BARS} from ({_ERROR_COUNTRY}) where country_code <> 'C3'
      and error_code_list in (select error_code_list from top_errors) {extra}"""


_BODIES = {
    "read_lab_csv": "select * from test",
    "read_lab_folder": "select * from test",
    "read_lab_columns": "select * from test",
    "read_lab_set": "select * from test",
    "first_in_file": "select * from test qualify row_number() over (partition by instrument_id order by test_id desc) = 1",
    "scan_ranges": """select part, count(*) "rows", min(tot_patient_test) least, max(tot_patient_test) greatest
      from (select tot_patient_test, cast(case when tot_patient_test is null then (select count(*) + 1 from cuts)
        else (select count(*) from cuts where cut <= tot_patient_test) end as int) part from test) group by part""",
    "blank_to_null": "select * from site",
    "write_table_csv": "select "
    + ", ".join(f"coalesce(cast({c} as varchar), 'NA') {c}" for c in lv.TEST)
    + " from test",
    "csv_round_trip": "select error_type_id, nullif(nullif(error_type_name, ''), 'NA') error_type_name,"
    " nullif(nullif(error_type_description, ''), 'NA') error_type_description, supplier_id from odd_texts",
    "site_error_files": _SITE_CODE,
    "model_upper": "select instrument_id, replace(upper(instrument_model), '®', '') instrument_model, supplier_site_id from instrument_master",
    "model_ascii_lower": "select * from models_ascii",
    "active_instruments": "select instrument_id, upper(instrument_model) instrument_model, supplier_site_id from instrument_master"
    " where instrument_id in (select instrument_id from test_activity_roche)",
    "activity_enriched": "select * from abbott",
    "activity_hiv_tests": f"select a.*, tt.test_type_psm from test_activity_abbott a left join test_type tt"
    f" on a.test_type_id {_SAME} tt.test_type_id where tt.test_type_psm in ('EID', 'EID/VL', 'VL')",
    "model_family_filter": "select record_key, instrument_id, instrument_model, supplier_site_id from roche"
    " where instrument_model like '%00%'",
    "plate_well": "select test_record_id, nullif(regexp_extract(test_record_id, '\\|(\\d+)$', 1), '') well_number,"
    " regexp_replace(test_record_id, '\\|\\d+$', '') plate_id from test_activity_abbott",
    "plate_parts": """select test_record_id, p[1] "date", p[2] test_type, p[3] barcode, p[4] "log", p[5] sample_number,
      concat(coalesce(p[1], 'NA'), ' ', coalesce(p[2], 'NA'), ' ', coalesce(p[3], 'NA'), ' ', coalesce(p[4], 'NA')) plate
      from (select test_record_id, string_split(test_record_id, '|') p from test_activity_abbott)""",
    "abbott_error_codes": f"""select instrument_id, instrument_model, supplier_site_id, supplier_site_name, country_code, well_number,
      test_type_id, test_type_psm, t.code error_type_id, error_type_name, error_type_description, error_count,
      cast(test_date as varchar) test_date, is_patient_test, is_control_test, patient_test_error_flag, control_test_error_flag,
      excluded_tests, test_month_year from tas_clean t left join error_type e on t.code {_SAME} e.error_type_id
      where t.error_type_id is not null""",
    "affected_plates": "select * from affected",
    "total_plates": "select * from total",
    **{f"{kind}_{level}": sql for level, keys in _LEVELS.items() for kind, sql in _plates_at(keys).items()},
    "percent_plates_levels": " union all by name ".join(
        f"select '{level}' as level, * from ({_plates_at(keys)['percent_plates']})" for level, keys in reversed(_LEVELS.items())
    ),
    "plate_state_shares": _plates_at(_LEVELS["my_country"])["percent_plates"],
    "tests_per_date": "select test_date, count(*) n from test where supplier_id = 1000 group by all",
    "countries_sites": """select country_code, supplier_site_id,
      cast(count(distinct instrument_id) + max(case when instrument_id is null then 1 else 0 end) as bigint) instruments,
      count(*) tests from roche group by all""",
    "error_codes_long": "select country_code, supplier_site_id, instrument_id, instrument_model, error_code_list from code_slots"
    " where error_code_list is not null",
    "top_codes_model": _top5("country_code, instrument_model"),
    "top_codes_instrument": _top5("country_code, instrument_id"),
    "top_codes_country": _top5("country_code"),
    "top_codes_global": _top5(""),
    "top_codes_series": _top5_series("country_code, instrument_model", "country_code, "),
    "top_codes_country_series": _top5_series("country_code", ""),
    "codes_nearest_month": 'select country_code, supplier_site_id, instrument_model, test_date, error_code_list, "month" from family_slots',
    "monthly_code_rate": "select * from monthly",
    "tally_state_rates": "select * from monthly",
    "monthly_code_rate_15": _monthly_rate("(select * from family_slots where slot < 15)"),
    "monthly_code_rate_per_test": "select * replace (tests // 15 as tests, n * 100 / (tests // 15) as error_percent) from monthly",
    "site_monthly_code_rate": "select * from site_monthly",
    "site_code_rate": _SITE_CODE,
    "top_errors_country": "select * from top_errors",
    "country_error_series": f"""select *, {_BARS} from monthly m where exists (select 1 from top_errors t
      where t.country_code = m.country_code and t.error_code_list = m.error_code_list)""",
    "error_country_series": _error_country(""),
    "error_country_series_short": _error_country("and \"month\" > date '2000-11-01'"),
    "mean_code_rate_country": "select country_code, error_code_list, round(avg(percent), 9) percent from recent group by all",
    "total_errors_by_site": """select supplier_site_id, cast(sum(n) as bigint) n, cast(sum(tests) as bigint) tests,
      sum(n) * 100 / sum(tests) percent from recent group by all""",
    "site_error_series_filled": f"""select supplier_site_id, error_code_list, "month", percent, cast("month" + 14 as date) x,
      case when percent > 0 then {_label("percent")} else '' end "label" from
      (select s.supplier_site_id, c.error_code_list, m."month", coalesce(r.percent, 0) percent
       from (select distinct supplier_site_id from recent) s
       cross join (select unnest(['6284.6', '6284.5', '6282.18', '6284.8']) error_code_list) c
       cross join (select distinct "month" from family_slots where "month" > date '2000-11-01') m
       left join recent r on r.supplier_site_id = s.supplier_site_id and r.error_code_list = c.error_code_list
       and r."month" = m."month")""",
    "roche_errors": "select * from second",
    "roche_errors_9": "select * from second where \"name\" between 'a' and 'i'",
    "error_share_all": """select error_code_list, error_type_description, count(*) n,
      count(*) * 100 / (select count(distinct internal_id) from second) error_percent
      from second where error_code_list is not null group by all""",
    "error_rate_site": _rate("country_code, supplier_site_name", "supplier_site_name", "country_code, supplier_site_name"),
    "error_rate_instrument": _rate(
        "instrument_id, instrument_model, country_code, supplier_site_name",
        "instrument_id",
        "instrument_id, instrument_model, country_code, supplier_site_name",
    ),
    "error_rate_month": _rate("country_code, test_month_year", "country_code, test_month_year", "country_code, test_month_year"),
    "kit_error_log": "select * from kit_log",
    "kit_error_totals": f"""select min(category_message) error_category, error_type_id error_code, {_sum_na('error_count')} total_errors
      from kit_log group by error_type_id""",
    "kit_error_bars": f"""select *, row_number() over (order by total_errors nulls last, error_code) display_rank
      from (select min(category_message) error_category, error_type_id error_code, {_sum_na('error_count')} total_errors
        from kit_log group by error_type_id)""",
    "plate_status": "select * from plate_state",
    "plate_status_by_country": """select country_name, count(*) filter (where control_errors = 'affected') affected,
      count(*) filter (where control_errors = 'non-affected') "non-affected" from plate_state
      where country_name is not null group by all""",
    "tests_last_year": "select * from df_tests",
    "tests_last_year_blanks": "select * replace (nullif(country_name, 'NATION_3') as country_name) from df_tests",
    "sites_instruments_country": "select * from df_sites_inst",
    "test_sample_table": _SAMPLE,
    "test_error_table": _ERRORS,
    "test_perc_table": _SHARE,
    "test_perc_table_seen": _SHARE,
    "instruments_country_seen": _quarter_counts("country_name, instrument_model"),
    "report_period": "select min(test_date) first_test_date, max(test_date) last_test_date from df_tests",
    "display_table": "select coalesce(\"Country\", '—') \"Country\", "
    + ", ".join(_short_number(c) for c in (*_TYPES, "Total sites", "Total instruments"))
    + f" from ({_SAMPLE})",
    "display_table_percent": "select coalesce(\"Country\", '—') \"Country\", "
    + ", ".join(f"coalesce(format('{{:,.1f}}', \"{c}\" * 100) || '%', '—') \"{c}\"" for c in _TYPES)
    + ', cast("Total sites" as varchar) "Total sites", cast("Total instruments" as varchar) "Total instruments"'
    + f" from ({_SHARE})",
    "instruments_by_quarter": "select * from df_instruments",
    "instruments_global": _quarter_counts("instrument_model"),
    "instruments_country": _quarter_counts("country_name, instrument_model"),
    "geocode_queries": "select *, site_name_city_country || ' laboratory' query from queries_text",
    "flatten_candidates": """select q.supplier_site_id, q.site_name_city_country supplier_site_name_city_country, candidate_name,
      candidate_address, candidate_lat, candidate_lon from queries_text q left join place_candidates p using (supplier_site_id)""",
    "lab_filters": "select * from labs",
    "active_lab_sites": "select * from sites",
    "nearest_lab": f"""select s.*, b."name" datim_name, b.id, round(b.d / 1000, 2) distance_nearest_datim_loc_km,
      b.latitude datim_lat, b.longitude datim_lon from sites s left join
      (select *, {_HAVERSINE} d from sites cross join labs where candidate_lat is not null
       qualify row_number() over (partition by supplier_site_id order by d, id) = 1) b
      on s.supplier_site_id = b.supplier_site_id""",
}

REFERENCE_SQL: dict[str, str] = {name: _with(body) for name, body in _BODIES.items()}
