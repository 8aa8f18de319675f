"""The work-order table: its columns, their standard names, and the fixed cleaning values."""

from __future__ import annotations

from pyspark.sql import types as T

# Source column -> standard column name, in table order.
STANDARD_NAMES = {
    "assetnum": "设备编号",
    "wonum": "工单号",
    "location": "位置编码",
    "station_name": "车站名称",
    "cust_linenum": "线路编号",
    "current_faildate": "故障时间",
    "prev_faildate": "上次故障时间",
    "total_failure_count": "累计故障次数",
    "is_first_failure": "是否首次故障",
    "worktype": "工单类型",
    "description": "故障描述",
    "cust_brand": "设备品牌",
    "cust_subsys": "子系统",
    "failurecode": "故障代码",
    "problemcode": "问题代码",
    "failurecode_name": "故障代码名称",
    "problemcode_name": "问题代码名称",
    "repair_start_time": "维修开始时间",
    "repair_end_time": "维修完成时间",
    "repair_type": "维修类型",
    "repair_location": "维修位置",
    "repair_duration_hours": "维修时长_小时",
    "start_of_operation": "投运日期",
    "cust_fixby": "维修人员编号",
    "responsible_person": "负责人",
    "problem_desc": "问题详细描述",
    "cause_desc": "原因描述",
    "remedy_desc": "解决方法描述",
    "manual_remark": "手动备注",
}

# Rows without one of these are useless; these hold times; these get a default.
CORE_COLUMNS = ("assetnum", "current_faildate", "repair_end_time")
TIME_COLUMNS = ("current_faildate", "prev_faildate", "repair_start_time", "repair_end_time",
                "start_of_operation")
DEFAULTS = {
    "cust_brand": "未知",
    "cust_subsys": "未知",
    "failurecode": "未知",
    "problemcode": "未知",
    "failurecode_name": "未知",
    "problemcode_name": "未知",
    "repair_type": "未知",
    "problem_desc": "无",
    "cause_desc": "无",
    "remedy_desc": "无",
    "manual_remark": "无",
}
PERIOD = ("2020-01-01", "2026-12-31")

NUMERIC = {"total_failure_count": T.IntegerType(), "is_first_failure": T.IntegerType(),
           "repair_duration_hours": T.DoubleType()}


def raw_schema() -> T.StructType:
    """Raw work orders: times still text, in whatever spelling they came."""
    return T.StructType([T.StructField(c, NUMERIC.get(c, T.StringType())) for c in STANDARD_NAMES])


def clean_schema() -> T.StructType:
    """Cleaned work orders: times parsed."""
    return T.StructType([
        T.StructField(c, T.TimestampNTZType() if c in TIME_COLUMNS else
                      NUMERIC.get(c, T.StringType())) for c in STANDARD_NAMES])
