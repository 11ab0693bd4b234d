"""The same queries as plain SQL, written against the given tables."""

_COMMITS = """commits as (
  select concat('lake.raw.u', user_id) as table_name, event_id as version, ts, epoch_us(ts) as ts_us, epoch_us(ts) // 1000 as ts_ms,
         case event_type when 'signup' then 'CLONE' when 'purchase' then 'MERGE' else 'WRITE' end as operation
  from events)"""

_STATE = """ids as (select distinct user_id // 3 as gid from events),
state as (
  select concat('ws', gid % 10) as workspace_name, concat('g', gid) as group_name, gid, gid % 10 as kind,
         case when gid % 10 < 7 then concat('wf', gid) else '' end as workflow_name,
         case when gid % 10 < 7 then cast(gid as varchar) else '' end as workflow_id,
         gid % 10 <> 3 as validated,
         case when gid % 10 in (0, 4, 8) then null
              when gid % 10 = 6 then 1706659200000
              else 1704844800000 + (gid % 10) * 86400000 end as last_ms,
         case when gid % 10 in (2, 9) then 100000 else 15 end as interval_mins,
         case when gid % 10 = 2 then 100000 else 10 end as failover_mins
  from ids),
members as (
  select workspace_name, group_name, gid, kind, workflow_name, last_ms, i as position,
         concat('lake.raw.u', gid * 3 + i) as table_name
  from state, (values (0), (1), (2)) t(i))"""

_DECISIONS = """activity as (
  select m.group_name, coalesce(bool_or(c.ts_us > m.last_ms * 1000), false) as has_new
  from members m left join commits c on c.table_name = m.table_name group by m.group_name),
run_ends as (
  select s.group_name, max(epoch_us(e.ts) // 1000) as run_end
  from state s join events e on e.user_id // 3 = s.gid
  where e.event_type = 'purchase' and s.kind not in (1, 2, 4)
    and (s.last_ms is null or epoch_us(e.ts) // 1000 > s.last_ms)
  group by s.group_name),
facts as (
  select s.*, a.has_new, r.run_end, 1706745600000 as now_ms
  from state s join activity a on a.group_name = s.group_name
  left join run_ends r on r.group_name = s.group_name),
decided as (
  select *, case
    when not (last_ms is null or has_new) then 'skip:no_new_commits'
    when workflow_id <> '' then case
      when not validated then 'skip:not_validated'
      when run_end is not null then 'workflow_time'
      when last_ms is null then 'skip:no_successful_run'
      when now_ms - last_ms > failover_mins * 60000::bigint then 'threshold_time'
      else 'skip:waiting_for_workflow' end
    else case
      when last_ms is null or now_ms - last_ms > interval_mins * 60000::bigint then 'schedule_time'
      else 'skip:interval_not_met' end
    end as decision
  from facts),
decisions as (
  select *, case decision when 'workflow_time' then run_end when 'threshold_time' then now_ms
            when 'schedule_time' then now_ms end as cutoff_ms
  from decided)"""


def _latest(targets: str, cutoff: str, condition: str = "true") -> str:
    """Every target with its latest commit at or before its cutoff."""
    return f"""select m.*, c.version, c.ts_ms as commit_ms, c.operation as op
  from {targets} m left join commits c
    on c.table_name = m.table_name and c.ts_us <= m.{cutoff} * 1000 and {condition}
  qualify row_number() over (
    partition by m.group_name, m.table_name order by c.ts_us desc nulls last, c.version desc) = 1"""


_CONFIG = """workspaces as (
  select 'scope' as secret_scope, c_name as workspace_name,
         case when c_acctbal >= 0 then concat('host', c_nationkey) end as workspace_instance_url,
         case when c_mktsegment = 'MACHINERY' then '' else 'key' end as workspace_pat_key,
         'primary' as sync_location_primary,
         case when c_nationkey <> 3 then 'secondary' end as sync_location_secondary,
         case c_mktsegment when 'BUILDING' then 0 when 'FURNITURE' then null
              else c_nationkey * 10 + 5 end as sync_interval_mins,
         case c_mktsegment when 'HOUSEHOLD' then 0 else c_nationkey * 20 + 5 end
              as sync_failover_interval_mins,
         case c_mktsegment when 'BUILDING' then '' when 'MACHINERY' then null else '5' end
              as sync_max_retries
  from customer),
groups as (
  select printf('Customer#%09d', o_custkey) as workspace_name,
         case o_orderpriority when '1-URGENT' then null when '5-LOW' then ''
              when '2-HIGH' then 'scheduled_sync' when '3-MEDIUM' then concat('g', o_orderkey)
              else concat('g', o_orderstatus) end as group_name,
         case o_orderstatus when 'O' then concat('wf', year(o_orderdate)) when 'P' then '' end as workflow,
         case when o_totalprice < 100000 then null when o_totalprice < 150000 then []
              else [concat('lake.sales.o', o_orderkey), concat('lake.sales.c', o_custkey)] end as tables
  from orders),
kept as (
  select workspace_name, coalesce(group_name, 'Unnamed') as group_name, workflow, tables from groups
  where coalesce(group_name, 'Unnamed') <> ''
    and (coalesce(workflow, '') <> '' or coalesce(len(tables), 0) > 0
         or group_name = 'scheduled_sync'))"""

_DEFAULTS = """defaults as (
  select workspace_name,
         cast(case when coalesce(sync_interval_mins, 0) = 0 then 720 else sync_interval_mins end as bigint)
           as sync_interval_mins,
         cast(case when coalesce(sync_failover_interval_mins, 0) = 0 then 2160
              else sync_failover_interval_mins end as bigint) as sync_failover_interval_mins,
         case when coalesce(sync_max_retries, '') = '' then '3' else sync_max_retries end as sync_max_retries
  from workspaces)"""

_DECLARED = """old as (
  select concat('ws', c_nationkey) as workspace_name, c_name as group_name, c_mktsegment as workflow_name,
         cast(c_custkey as varchar) as workflow_id, concat('lake.crm.c', c_custkey) as tables,
         c_acctbal >= 3000 as validated, 1706745600000 - c_custkey * 1000 as last_ms
  from customer where c_acctbal < 6000),
new as (
  select concat('ws', c_nationkey) as workspace_name, c_name as group_name,
         case when c_mktsegment <> 'BUILDING' then c_mktsegment end as workflow_name,
         concat('j', c_custkey) as workflow_id,
         case when c_nationkey = 7 then 'lake.crm.all' else concat('lake.crm.c', c_custkey) end as tables
  from customer where c_acctbal > 0),
listed as (
  select distinct concat('lake.crm.c', o_custkey) as table_name from orders)"""

_MEASURED = f"""source as (select s.*, 1000 + s.version % 3 as size from (
  {_latest("members", "last_ms")}) s where s.version is not null),
targets as (select *, last_ms - 86400000 as target_ms from members),
target as (select s.*, 1000 + s.version % 3 as size from (
  {_latest("targets", "target_ms")}) s where s.version is not null)"""

_ROW = """workspace_name, group_name, table_name"""


def _md5_number(text: str, start: int, length: int) -> str:
    return f"cast(concat('0x', substr(md5({text}), {start}, {length})) as bigint)"


def _generated() -> str:
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    key = "concat('7:', o_orderkey)"
    letters = ", ".join(
        f"substr('{alphabet}', {_md5_number(key, 1 + 3 * i, 3)} % 62 + 1, 1)" for i in range(10)
    )
    value = _md5_number("concat('7:', o_orderkey, ':value')", 1, 8)
    return f"select o_orderkey as id, concat({letters}) as name, {value} % 100 + 1 as value from orders"


_ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_orderpriority"

_ALTERED = """altered as (
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount,
         case when l_linestatus = 'F' and l_quantity = 7 then null else l_tax end as l_tax,
         l_returnflag, l_linestatus, l_shipdate
  from lineitem where not (l_returnflag = 'A' and l_quantity = 50)
  union all
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount,
         l_tax, l_returnflag, l_linestatus, l_shipdate
  from lineitem where l_returnflag = 'R' and l_quantity = 49),
marked as (
  select l_orderkey, l_linenumber, 1 as s, 0 as d,
         concat_ws('|', l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount,
                   coalesce(cast(l_tax as varchar), 'NULL'), l_returnflag, l_linestatus, l_shipdate) as body
  from lineitem
  union all
  select l_orderkey, l_linenumber, 0, 1,
         concat_ws('|', l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount,
                   coalesce(cast(l_tax as varchar), 'NULL'), l_returnflag, l_linestatus, l_shipdate)
  from altered),
bodies as (
  select l_orderkey, l_linenumber, body, sum(s) as s, sum(d) as d from marked group by all)"""

_NEWEST = """select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type,
  arg_max(value, event_id) as value from events group by user_id"""

_BY_SOURCE = """select source, cast(sum(strlen(text) + 1) as bigint) as bytes,
       cast(sum(length(text) + 1) as bigint) as chars from documents group by source"""


def all_oracles() -> dict[str, str]:
    return {
        "q_version_as_of": f"""with {_COMMITS}
            select table_name, version, ts_ms as commit_ms from commits
            where ts_us <= 1705276800000000
            qualify row_number() over (partition by table_name order by ts_us desc, version desc) = 1""",
        "q_version_as_of_targets": f"""with {_COMMITS}, {_STATE}
            select {_ROW}, last_ms as cutoff_ms, version, commit_ms from ({_latest("members", "last_ms")})""",
        "q_clone_version_as_of": f"""with {_COMMITS}, {_STATE}
            select {_ROW}, last_ms as cutoff_ms, version, commit_ms, version as source_version
            from ({_latest("members", "last_ms", "c.operation = 'CLONE'")})""",
        "q_group_tables": f"""with {_STATE}
            select {_ROW}, cast(position as bigint) as position, 'lake' as catalog, 'raw' as schema,
                   concat('u', gid * 3 + position) as "table",
                   concat('stage/lake/raw/u', gid * 3 + position) as path from members""",
        "q_version_as_of_many": f"""with {_COMMITS}
            select a.table_name, a.ts_us // 1000 + 21600000 as cutoff_ms, max(b.version) as version
            from commits a join commits b
              on a.table_name = b.table_name and b.ts_us <= (a.ts_us // 1000 + 21600000) * 1000
            group by a.table_name, a.ts_us, a.version""",
        "q_new_commits_by_group": f"""with {_COMMITS}, {_STATE}
            select m.workspace_name, m.group_name, coalesce(bool_or(c.ts_us > m.last_ms * 1000), false) as has_new
            from members m left join commits c on c.table_name = m.table_name
            group by m.workspace_name, m.group_name""",
        "q_new_commits_stored": f"""with {_COMMITS}, {_STATE}
            select m.workspace_name, m.group_name, coalesce(bool_or(
                     c.ts_us > (1705276800000 + m.last_ms % 86400000) * 1000), false) as has_new
            from members m left join commits c on c.table_name = m.table_name
            group by m.workspace_name, m.group_name""",
        "q_latest_success": f"""with {_STATE}
            select cast(s.gid as varchar) as job_id, s.last_ms, max(epoch_us(e.ts) // 1000) as run_end_ms
            from state s left join events e
              on e.user_id // 3 = s.gid and e.event_type = 'purchase' and s.kind not in (1, 2, 4)
             and (s.last_ms is null or epoch_us(e.ts) // 1000 > s.last_ms)
            where s.kind < 7 group by s.gid, s.last_ms""",
        "q_resolve_workflows": """with first as (
              select s_nationkey, cast(min(s_suppkey) as varchar) as workflow_id
              from supplier group by s_nationkey)
            select c_name as group_name, concat('wf', c_nationkey) as workflow, workflow_id
            from customer left join first on s_nationkey = c_nationkey""",
        "q_sync_plan": f"""with {_COMMITS}, {_STATE}, {_DECISIONS}
            select workspace_name, group_name, workflow_id, decision, cutoff_ms from decisions""",
        "q_copy_plan": f"""with {_COMMITS}, {_STATE}, {_DECISIONS},
            due as (select d.workspace_name, d.group_name, m.table_name, d.cutoff_ms, d.decision
                    from decisions d join members m on m.group_name = d.group_name
                    where d.cutoff_ms is not null),
            found as ({_latest("due", "cutoff_ms")})
            select {_ROW}, cutoff_ms, version, commit_ms,
                   case when bool_and(version is not null) over (partition by group_name) then decision
                        else 'skip:no_version' end as decision from found""",
        "q_pending_delivery": f"""with {_STATE}, sent as (
              select *, case when kind in (1, 5) then null when kind = 7 then last_ms + 1
                        else last_ms end as in_ms from state)
            select workspace_name, group_name, last_ms as sync_time_to_region, in_ms as sync_time_in_region
            from sent where last_ms is not null and (in_ms is null or last_ms >= in_ms)""",
        "q_delivery_plan": f"""with {_COMMITS}, {_STATE},
            due as (select * from members where last_ms is not null and kind <> 7),
            found as ({_latest("due", "last_ms", "c.operation = 'CLONE'")})
            select {_ROW}, last_ms as sync_time_to_region, version, version as source_version,
                   case when bool_and(version is not null) over (partition by group_name) then 'deliver'
                        else 'skip:no_version' end as decision from found""",
        "q_config_load": f"""with {_CONFIG}
            select g.workspace_name, count(*) as documents,
                   cast(max(w.sync_interval_mins) as bigint) as sync_interval_mins,
                   max(w.sync_max_retries) as sync_max_retries, count(g.group_name) as named_groups,
                   count(g.workflow) as workflows,
                   cast(sum(coalesce(len(g.tables), 0)) as bigint) as tables
            from groups g join workspaces w on w.workspace_name = g.workspace_name
            group by g.workspace_name""",
        "q_workspace_lookup": f"""with {_CONFIG}
            select workspace_name, workspace_pat_key, sync_location_primary from workspaces
            where workspace_name = 'Customer#000000007'""",
        "q_config_violations": f"""with {_CONFIG}
            select workspace_name, 'workspace' as entity, 'missing_workspace_instance_url' as rule
            from workspaces where coalesce(workspace_instance_url, '') = ''
            union all select workspace_name, 'workspace', 'missing_workspace_pat_key'
            from workspaces where coalesce(workspace_pat_key, '') = ''
            union all select workspace_name, 'workspace', 'missing_sync_location_secondary'
            from workspaces where coalesce(sync_location_secondary, '') = ''
            union all select workspace_name, group_name, 'duplicate_group'
            from groups where coalesce(group_name, '') <> ''
            group by workspace_name, group_name having count(*) > 1
            union all select workspace_name, coalesce(group_name, 'Unnamed'), 'missing_tables'
            from groups where coalesce(workflow, '') <> '' and coalesce(len(tables), 0) = 0""",
        "q_config_defaults": f"with {_CONFIG}, {_DEFAULTS} select * from defaults",
        "q_valid_groups": f"""with {_CONFIG}
            select workspace_name, group_name, workflow,
                   coalesce(array_to_string(tables, ','), '') as tables from kept""",
        "q_config_summary": f"""with {_CONFIG}, {_DEFAULTS}
            select d.workspace_name, count(k.group_name) as groups_validated,
                   d.sync_interval_mins as default_schedule, d.sync_max_retries as max_retries
            from defaults d left join kept k on k.workspace_name = d.workspace_name group by all""",
        "q_config_changed": f"""with {_DECLARED}
            select old.workspace_name, old.group_name from old join new using (workspace_name, group_name)
            where coalesce(old.workflow_name, '') <> coalesce(new.workflow_name, '')
               or old.tables <> new.tables""",
        "q_missing_tables": f"""with {_DECLARED}
            select workspace_name, group_name, tables as table_name from new
            where tables not in (select table_name from listed)""",
        "q_unreadable_tables": """select 'lake.sales.orders' as table_name, count(*) as row_count, true as readable from orders
            union all select 'lake.sales.lineitem', count(*), false from lineitem
            union all select 'lake.sales.customer', count(*), count(*) = count(*) filter (c_acctbal >= 0) from customer
            union all select 'lake.sales.events', count(*), false from events
            union all select 'lake.sales.part', count(*), true from part""",
        "q_group_validity": f"""with {_DECLARED}, jobs as (
              select case o_orderpriority when '1-URGENT' then 'AUTOMOBILE' when '2-HIGH' then 'HOUSEHOLD'
                     else 'MACHINERY' end as name, concat('j', o_custkey) as job_id, o_orderkey from orders),
            first as (select name, arg_min(job_id, o_orderkey) as job_id from jobs group by name),
            joined as (
              select new.*, old.workflow_id as old_id, first.job_id,
                     coalesce(old.validated and old.workflow_name = coalesce(new.workflow_name, '')
                              and old.tables = new.tables, false) as known,
                     new.tables in (select table_name from listed) as listed
              from new left join old using (workspace_name, group_name)
              left join first on first.name = new.workflow_name)
            select workspace_name, group_name, coalesce(workflow_name, '') as workflow_name,
                   case when known then old_id when workflow_name is null then '' else job_id end as workflow_id,
                   tables,
                   known or (listed and (workflow_name is null or job_id is not null)) as validated
            from joined""",
        "q_config_merge": f"""with {_DECLARED},
            ours as (select concat('ws', n_nationkey) as workspace_name from nation where n_regionkey <> 0),
            pairs as (
              select coalesce(o.workspace_name, n.workspace_name) as workspace_name,
                     coalesce(o.group_name, n.group_name) as group_name,
                     o.group_name is not null as is_old, n.group_name is not null as is_new,
                     o.workflow_name as ow, o.workflow_id as oi, o.tables as ot, o.validated as ov, o.last_ms,
                     n.workflow_name as nw, n.workflow_id as ni, n.tables as nt
              from old o full join new n
                on o.workspace_name = n.workspace_name and o.group_name = n.group_name),
            judged as (
              select *, is_new and (not is_old or ow is distinct from nw or ot is distinct from nt
                                    or ov is distinct from true) as take
              from pairs where is_new or workspace_name not in (select workspace_name from ours))
            select workspace_name, group_name,
                   case when take then nw else ow end as workflow_name,
                   case when take then ni else oi end as workflow_id,
                   case when take then nt else ot end as tables,
                   case when take then true else ov end as validated,
                   case when not take then last_ms end as last_successful_run_time,
                   case when not take then 'Success' end as sync_status,
                   case when not take then 'workflow_time' end as sync_reason,
                   case when not take then last_ms + 1 end as sync_time_to_region,
                   case when not take then last_ms + 2 end as sync_time_in_region,
                   cast(null as varchar) as source_operation_metrics,
                   cast(null as varchar) as target_operation_metrics
            from judged""",
        "q_state_patch": f"""with {_DECLARED.replace("where c_acctbal < 6000", "")}
            select o.workspace_name, o.group_name, o.workflow_name, o.workflow_id, o.tables, o.validated,
                   o.last_ms as last_successful_run_time,
                   case when c.c_acctbal > 2000 then 'In Progress' else 'Success' end as sync_status,
                   'workflow_time' as sync_reason,
                   case when c.c_acctbal > 4000 then 1706745600000 else o.last_ms + 1 end as sync_time_to_region,
                   o.last_ms + 2 as sync_time_in_region,
                   cast(null as varchar) as source_operation_metrics,
                   cast(null as varchar) as target_operation_metrics
            from old o left join customer c on c.c_name = o.group_name and c.c_mktsegment <> 'BUILDING'""",
        "q_metrics_flatten": f"""with {_COMMITS}, {_STATE}, {_MEASURED}
            select {_ROW}, case when workflow_name <> '' then commit_ms end as sync_commit_timestamp,
                   case when workflow_name <> '' then version end as sync_commit_version,
                   size as source_table_size from source""",
        "q_sync_report": f"""with {_COMMITS}, {_STATE}, {_MEASURED}, sent as (
              select s.*, t.version as target_version, t.size as target_size,
                     case when s.kind in (1, 5) then null when s.kind = 7 then s.last_ms + 1
                          else s.last_ms end as in_ms,
                     1706745600 - s.last_ms // 1000 as seconds
              from source s left join target t
                on t.group_name = s.group_name and t.table_name = s.table_name)
            select {_ROW}, workflow_name, last_ms as last_successful_run_time,
                   case when kind < 7 then 'workflow_time' else 'schedule_time' end as sync_reason,
                   last_ms as sync_time_to_region, in_ms as sync_time_in_region,
                   case when workflow_name <> '' then version end as source_sync_commit_version,
                   size as source_table_size, target_version as target_sync_commit_version,
                   target_size as target_table_size,
                   ((seconds * 100 + 1800) // 3600)::double / 100::double as hours_since_last_sync,
                   case when size = target_size and (workflow_name = '' or version = target_version)
                        then 'Synced' else 'Not Synced' end as sync_status
            from sent""",
        "q_upsert": f"""with s as (
              select {_ORDERS}, o_totalprice * 2 as o_totalprice from orders where o_orderdate >= '1997-01-01'),
            t as (select {_ORDERS}, o_totalprice from orders where o_orderdate < '1999-01-01')
            select * from s union all
            select * from t where o_orderkey not in (select o_orderkey from s)""",
        "q_merge_counter": f"""with s as (
              select {_ORDERS}, o_totalprice from orders),
            top as (select coalesce(max(o_orderkey), 0) as m from orders)
            select s.*, m + row_number() over (order by o_totalprice, o_orderkey) as merge_counter
            from s, top""",
        "q_silver_filter": "select * replace (cast(ts as varchar) as ts) from events where value > 50",
        "q_gold_count": "select l_partkey, count(*) as count from lineitem group by l_partkey",
        "q_generate_raw": _generated(),
        "q_medallion_tables": f"""select name, count(*) as count from ({_generated()})
            where value > 50 group by name""",
        "q_clone_roundtrip": f"""select {_ORDERS}, o_totalprice,
            cast(o_orderdate as varchar) as o_orderdate from orders where o_orderdate < '1998-01-01'""",
        "q_clone_partitioned": """select * replace (cast(l_shipdate as varchar) as l_shipdate),
            lpad(cast(l_linenumber as varchar), 3, '0') as part from lineitem""",
        "q_register": """select 'one.sales.t' as table_name, o_orderkey as id from orders
            union all select 'two.sales.t', c_custkey from customer""",
        "q_stream_two_sources": """select 'orders' as source, o_orderkey as id from orders
            union all select 'customer', c_custkey from customer""",
        "q_stream_new_checkpoint": """select source, cast(sum(length(text) + 1) as bigint) as chars
            from documents group by source""",
        "q_reconcile": f"""with {_ALTERED}
            select l_orderkey, l_linenumber, cast(sum(s) as bigint) as src_rows,
                   cast(sum(d) as bigint) as dst_rows
            from bodies group by l_orderkey, l_linenumber having bool_or(s <> d)""",
        "q_reconcile_buckets": f"""with {_ALTERED}
            select 0 as bucket, cast(sum(s) as bigint) as src_rows, cast(sum(d) as bigint) as dst_rows
            from marked""",
        "q_change_set": f"""with {_ALTERED}
            select * replace (case when l_orderkey % 1000 = 1 then 0.5 else l_tax end as l_tax,
                              cast(l_shipdate as varchar) as l_shipdate) from altered""",
        "q_change_set_rows": f"""with {_ALTERED},
            changed as (
              select cast(sum(d) as bigint) as d from bodies group by l_orderkey, l_linenumber
              having bool_or(s <> d))
            select 0::bigint as version, count(*) as staged_rows, count(*) as table_rows from lineitem
            union all select 1, (select cast(sum(greatest(d, 1)) as bigint) from changed),
                   (select count(*) from altered)
            union all select 2, count(*), (select count(*) from altered) from altered where l_orderkey % 1000 = 1""",
        "q_reconcile_tree": f"""with {_ALTERED}
            select l_orderkey, l_linenumber, cast(sum(s) as bigint) as src_rows,
                   cast(sum(d) as bigint) as dst_rows
            from bodies group by l_orderkey, l_linenumber having bool_or(s <> d)""",
        "q_upsert_newest": _NEWEST,
        "q_upsert_stream_newest": _NEWEST,
        "q_changed_only_clone": f"""select {_ORDERS},
            case when o_custkey = 11 then 0.0 else o_totalprice end as o_totalprice from orders""",
        "q_group_sync": """select 'lake.sales.orders' as table_name, count(*) as row_count,
                   cast(sum(o_orderkey) as bigint) as key_sum from orders where o_orderdate < '1998-01-01'
            union all select 'lake.sales.lines', count(*), cast(sum(l_orderkey) as bigint)
            from lineitem where l_shipdate < '1998-01-01'
            union all select 'lake.crm.customer', count(*), cast(sum(c_custkey) as bigint) from customer""",
        "q_group_switch": """with seen(moment, early) as (values ('released', true), ('between', true), ('switched', false))
            select moment, 'lake.sales.orders' as table_name, count(*) as row_count,
                   cast(sum(o_orderkey) as bigint) as key_sum
            from seen, orders where not early or o_orderdate < '1998-01-01' group by moment
            union all select moment, 'lake.sales.lines', count(*), cast(sum(l_orderkey) as bigint)
            from seen, lineitem where not early or l_shipdate < '1998-01-01' group by moment""",
        "q_sql_time_travel": """select 'at' as asked, o_orderstatus, count(*) as n from orders
              where o_orderdate < '1996-01-01' group by o_orderstatus
            union all select 'as_of', o_orderstatus, count(*) from orders
              where o_orderdate < '1998-01-01' group by o_orderstatus
            union all select 'gained', o_orderstatus, count(*) from orders
              where o_orderdate >= '1998-01-01' and o_orderdate < '2100-01-01' group by o_orderstatus
            union all select 'before', '-', 0""",
        "q_sql_state": f"""with {_DECLARED.replace("where c_acctbal < 6000", "")},
            held as (
              select workspace_name, group_name, workflow_name, tables,
                     case when validated then 1706745600000 else last_ms + 2 end as sync_time_in_region from old)
            select * from held
            union all select 'one', group_name, workflow_name, tables, sync_time_in_region
            from held where group_name = 'Customer#000000001'""",
        "q_group_sync_report": """select * from (values
              ('sales', 'lake.sales.orders', 'workflow_time', 0::bigint, 0::bigint, 'Synced'),
              ('sales', 'lake.sales.lines', 'workflow_time', 0, 0, 'Synced'),
              ('scheduled_sync', 'lake.crm.customer', 'schedule_time', null, 0, 'Synced'))
            t(group_name, table_name, sync_reason, source_sync_commit_version,
              target_sync_commit_version, sync_status)""",
        "q_run_summary": """with sized as (
              select (select count(*) from orders) + (select count(*) from lineitem) as good,
                     (select count(*) from customer) as scheduled)
            select s.* from sized, lateral (values
              ('sender', 'good', 'workflow_time', 'Success', false, good),
              ('sender', 'broken', 'workflow_time', null, true, null),
              ('sender', 'waiting', 'skip:no_successful_run', null, false, null),
              ('sender', 'absent', 'skip:no_version', null, false, null),
              ('sender', 'scheduled_sync', 'schedule_time', 'Success', false, scheduled),
              ('receiver', 'good', 'deliver', 'Success', false, good),
              ('receiver', 'scheduled_sync', 'deliver', 'Success', false, scheduled))
            s(mode, group_name, decision, sync_status, failed, row_count)""",
        "q_clone_sizes": """with sized as (
              select 'lake.sales.orders' as table_name, count(*) as row_count from orders
              union all select 'lake.sales.lineitem', count(*) from lineitem
              union all select 'lake.sales.customer', count(*) from customer)
            select 'staged' as copy, *, true as bytes_agree from sized
            union all select 'delivered', *, true from sized""",
        "q_archived_files": """select source, cast(sum(strlen(text) + 1) as bigint) as archived_bytes,
            0::bigint as left_bytes from documents group by source""",
        "q_ingest_files": _BY_SOURCE,
        "q_ingest_stream": _BY_SOURCE,
        "q_medallion_files": """select source, 1706745600000 as merge_ms,
            cast(sum(length(text) + 1) as bigint) as chars from documents group by source""",
        "q_upsert_stream": """with a as (
              select o_custkey, count(*) as n, max(o_totalprice) as top from orders
              where o_orderdate < '2001-01-01' group by o_custkey),
            b as (select o_custkey, count(*) as n, max(o_totalprice) as top from orders
              where o_orderdate >= '2001-01-01' group by o_custkey)
            select * from b union all
            select * from a where o_custkey not in (select o_custkey from b)""",
    }
