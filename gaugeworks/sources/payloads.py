"""Landed API payloads flattened to rows: shows, products, locations, thermostats, meters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.operators.shows import normalise


def _text(value: Column) -> Column:
    return F.coalesce(F.trim(value), F.lit(""))


def _first(items: Column) -> Column:
    return F.get(items, F.lit(0))


# ---- shows ---------------------------------------------------------------------------

_NAMED = "struct<name:string,id:string>"
TICKET_EVENT = (
    f"struct<id:string,name:string,url:string,_embedded:struct<venues:array<struct<name:string,"
    f"city:struct<name:string>,state:struct<stateCode:string>>>,attractions:array<{_NAMED}>>,"
    f"classifications:array<struct<genre:{_NAMED},segment:{_NAMED},subGenre:{_NAMED}>>,"
    "dates:struct<start:struct<dateTime:string,localDate:string>>>"
)
SEAT_EVENT = (
    "struct<id:string,title:string,short_title:string,url:string,datetime_utc:string,"
    "datetime_local:string,venue:struct<name:string,city:string,state:string>,"
    "performers:array<struct<name:string,primary:boolean>>,taxonomies:array<struct<name:string>>>"
)


def ticket_events(payloads: DataFrame, payload: str = "payload", source: str = "ticketmaster") -> DataFrame:
    """Events of the venue / attraction layout in the SHOW schema."""
    e = F.from_json(payload, TICKET_EVENT)
    venue, act = _first(e["_embedded"]["venues"]), _first(e["_embedded"]["attractions"])
    kind = _first(e["classifications"])

    def name(value: Column) -> Column:
        return F.coalesce(F.nullif(value["name"], F.lit("")), F.nullif(value["id"], F.lit("")))

    start = e["dates"]["start"]
    return normalise(payloads.select(
        F.lit(source).alias("source"), _text(e["id"]).alias("provider_event_id"),
        F.coalesce(name(act), e["name"]).alias("artist_or_title"),
        _text(venue["name"]).alias("venue"), _text(venue["city"]["name"]).alias("city"),
        _text(venue["state"]["stateCode"]).alias("state"),
        F.coalesce(F.nullif(start["dateTime"], F.lit("")), start["localDate"]).alias("starts_at"),
        _text(e["url"]).alias("ticket_url"),
        F.coalesce(name(kind["genre"]), name(kind["segment"]), name(kind["subGenre"])).alias(
            "genre_or_classification")))


def seat_events(payloads: DataFrame, payload: str = "payload", source: str = "seatgeek") -> DataFrame:
    """Events of the performer / taxonomy layout in the SHOW schema."""
    e = F.from_json(payload, SEAT_EVENT)
    lead = F.coalesce(_first(F.filter(e["performers"], lambda p: p["primary"])), _first(e["performers"]))
    names = F.filter(F.transform(e["taxonomies"], lambda t: t["name"]), lambda n: F.coalesce(n, F.lit("")) != "")

    def filled(value: Column) -> Column:
        return F.nullif(value, F.lit(""))

    return normalise(payloads.select(
        F.lit(source).alias("source"), e["id"].alias("provider_event_id"),
        F.coalesce(filled(lead["name"]), filled(e["title"]), filled(e["short_title"])).alias("artist_or_title"),
        e["venue"]["name"].alias("venue"), e["venue"]["city"].alias("city"), e["venue"]["state"].alias("state"),
        F.coalesce(filled(e["datetime_utc"]), e["datetime_local"]).alias("starts_at"),
        e["url"].alias("ticket_url"),
        F.array_join(F.array_sort(F.array_distinct(names)), ", ").alias("genre_or_classification")))


# ---- products and locations ----------------------------------------------------------

PRODUCTS = (
    "struct<data:array<struct<productId:string,upc:string,description:string,brand:string,"
    "items:array<struct<price:struct<regular:string>,size:string,upc:string>>>>,"
    "meta:struct<pagination:struct<total:string>>>"
)
LOCATIONS = (
    "struct<data:array<struct<locationId:string,name:string,chain:string,phone:string,"
    "address:struct<addressLine1:string,city:string,state:string,zipCode:string>,"
    "departments:array<struct<departmentId:string>>>>>"
)
PICKUP_DEPARTMENT = "94"


def products(payloads: DataFrame, payload: str = "payload", keep: Sequence[str] = ()) -> DataFrame:
    """Products of search payloads with price, size and upc of the first item, and the
    stated result total, never negative."""
    parsed = payloads.withColumn("_p", F.from_json(payload, PRODUCTS))
    total = F.greatest(F.lit(0), F.col("_p.meta.pagination.total").try_cast("int"))
    rows = parsed.withColumn(
        "result_total", F.when(F.col("_p.meta.pagination.total").try_cast("int").isNotNull(), total)
    ).select(*keep, "result_total", F.explode("_p.data").alias("_i"))
    first = _first(F.col("_i.items"))
    upc = F.coalesce(F.nullif("_i.upc", F.lit("")), F.nullif(first["upc"], F.lit("")))
    return rows.filter(F.coalesce("_i.productId", F.lit("")) != "").select(
        *keep, F.col("_i.productId").alias("product_id"), upc.alias("upc"),
        F.coalesce("_i.description", F.lit("")).alias("description"), "_i.brand",
        F.nullif(first["size"], F.lit("")).alias("size"), first["price"]["regular"].alias("price"),
        "result_total")


def phone_label(raw: Column) -> Column:
    digits = F.regexp_replace(raw, r"\D", "")
    shaped = F.regexp_replace(digits, r"^(\d{3})(\d{3})(\d{4})$", "($1) $2-$3")
    return F.when(F.coalesce(raw, F.lit("")) == "", F.lit(None)).when(
        F.length(digits) == 10, shaped).otherwise(raw)


def locations(payloads: DataFrame, payload: str = "payload", keep: Sequence[str] = (),
              pickup_department: str = PICKUP_DEPARTMENT, default_name: str = "Kroger") -> DataFrame:
    rows = payloads.select(*keep, F.explode(F.from_json(payload, LOCATIONS)["data"]).alias("_l"))
    pickup = F.exists("_l.departments", lambda d: d["departmentId"] == pickup_department)
    a = F.col("_l.address")

    def blank(value: Column) -> Column:
        return F.coalesce(value, F.lit(""))

    return rows.filter(_text(F.col("_l.locationId")) != "").select(
        *keep, F.trim("_l.locationId").alias("location_id"),
        F.coalesce(F.nullif("_l.name", F.lit("")), F.nullif("_l.chain", F.lit("")), F.lit(default_name)).alias("name"),
        blank(a["addressLine1"]).alias("address_line1"), blank(a["city"]).alias("city"),
        blank(a["state"]).alias("state"), blank(a["zipCode"]).alias("zip_code"),
        F.coalesce(pickup, F.lit(False)).alias("has_pickup"), phone_label(F.col("_l.phone")).alias("phone"),
        "_l.chain")


# ---- thermostats ---------------------------------------------------------------------

THERMOSTAT = "sdm.devices.types.THERMOSTAT"
_TRAITS = {
    "info": "Info", "temperature": "Temperature", "humidity": "Humidity",
    "mode": "ThermostatMode", "hvac": "ThermostatHvac",
    "setpoint": "ThermostatTemperatureSetpoint", "eco": "ThermostatEco",
    "connectivity": "Connectivity",
}
DEVICES = (
    "struct<devices:array<struct<name:string,type:string,"
    "parentRelations:array<struct<parent:string,displayName:string>>,traits:map<string,string>>>>"
)


def fahrenheit(celsius: Column) -> Column:
    """Nearest whole degree, halves to even as in the published behaviour."""
    return F.bround(celsius * 9 / 5 + 32, 0).cast("int")


def room_key(name: Column) -> Column:
    key = F.lower(F.regexp_replace(F.regexp_replace(F.trim(name), r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", ""))
    return F.coalesce(F.nullif(key, F.lit("")), F.lit("thermostat"))


def thermostats(payloads: DataFrame, payload: str = "payload", keep: Sequence[str] = ("site_id", "ts")):
    """One row per thermostat of a devices payload; other device types are left out."""
    rows = payloads.select(*keep, F.explode(F.from_json(payload, DEVICES)["devices"]).alias("_d"))
    rows = rows.filter(F.col("_d.type") == THERMOSTAT)

    def trait(kind: str, field: str) -> Column:
        body = F.try_element_at(F.col("_d.traits"), F.lit(f"sdm.devices.traits.{_TRAITS[kind]}"))
        return F.get_json_object(body, f"$.{field}")

    def number(kind: str, field: str) -> Column:
        return trait(kind, field).try_cast("double")

    name = F.coalesce(
        F.nullif(_text(_first(F.col("_d.parentRelations"))["displayName"]), F.lit("")),
        F.nullif(_text(trait("info", "customName")), F.lit("")),
        F.nullif(F.substring_index(F.coalesce("_d.name", F.lit("")), "/", -1), F.lit("")), F.lit("thermostat"))
    raw_mode = trait("mode", "mode")
    eco = F.coalesce(trait("eco", "mode"), F.lit("OFF")) == "MANUAL_ECO"
    mode = F.when(eco, "MANUAL_ECO").otherwise(F.coalesce(F.nullif(raw_mode, F.lit("")), F.lit("OFF")))
    cool = F.when(eco, number("eco", "coolCelsius")).otherwise(number("setpoint", "coolCelsius"))
    heat = F.when(eco, number("eco", "heatCelsius")).otherwise(number("setpoint", "heatCelsius"))
    cool_f = F.when(mode != "HEAT", fahrenheit(cool))
    heat_f = F.when(mode != "COOL", fahrenheit(heat))
    guide = F.when(mode.isin("HEAT", "COOL", "HEATCOOL"), mode).otherwise(raw_mode)
    active = F.when(guide == "HEAT", heat_f).when(guide.isin("COOL", "HEATCOOL"), cool_f).otherwise(
        F.coalesce(cool_f, heat_f))
    return rows.select(
        *keep, room_key(name).alias("zone"), name.alias("name"),
        fahrenheit(number("temperature", "ambientTemperatureCelsius")).alias("temperature"),
        number("humidity", "ambientHumidityPercent").cast("int").alias("humidity"),
        mode.alias("mode"), trait("hvac", "status").alias("action"), active.alias("setpoint"),
        cool_f.alias("cool_setpoint"), heat_f.alias("heat_setpoint"),
        F.coalesce(F.upper(trait("connectivity", "status")) == "ONLINE", F.lit(False)).alias("online"))


# ---- meter registers -----------------------------------------------------------------

# Which appliance hangs on which meter channel; scales of the registers.
CHANNEL_MAP = (
    ("meter_1", 1, "ac_compressor"), ("meter_1", 2, "furnace_air_handler"),
    ("meter_2", 1, "dryer"), ("meter_2", 2, "dishwasher"),
)
POWER_SCALE, VOLT_SCALE, AMP_SCALE, ENERGY_SCALE = 10, 10, 1000, 100


def register_profile(registers: Column) -> Column:
    """Layout of a register map by the keys it holds."""
    def any_key(*keys: str) -> Column:
        return F.arrays_overlap(F.map_keys(registers), F.array(*[F.lit(k) for k in keys]))

    blocks = any_key("105", "106", "107", "108", "109", "115", "116", "117", "118", "119")
    return (
        F.when(any_key("107", "117"), "v_wifi_dl02_es").when(any_key("101", "112"), "pj1103a")
        .when(blocks, "v_wifi_dl02_es").otherwise("pj1103a"))


def meter_channels(readings: DataFrame, keep: Sequence[str] = ("site_id", "ts"), mapping=CHANNEL_MAP) -> DataFrame:
    """Appliance rows of dual-channel meters. Input: keep, meter, registers map<string,double>.

    Both channels are built as an array and exploded; the appliance is a constant lookup.
    """
    reg = F.col("registers")
    profile = register_profile(reg)

    def scaled(key: str, scale: int) -> Column:
        return F.try_element_at(reg, F.lit(key)) / float(scale)

    none = F.lit(None).cast("double")

    def channel(n: int, volt, power, amp, energy, inferred) -> Column:
        return F.struct(F.lit(n).alias("n"), volt.alias("voltage_v"), power.alias("power_w"),
                        amp.alias("current_a"), energy.alias("energy_forward_kwh"),
                        inferred.alias("energy_forward_kwh_inferred"))

    shared = F.array(
        channel(1, none, scaled("101", POWER_SCALE), scaled("113", AMP_SCALE), scaled("106", ENERGY_SCALE), none),
        channel(2, none, scaled("105", POWER_SCALE), scaled("114", AMP_SCALE), scaled("108", ENERGY_SCALE), none))
    blocks = F.array(
        channel(1, scaled("107", VOLT_SCALE), scaled("108", POWER_SCALE), none, none, scaled("109", ENERGY_SCALE)),
        channel(2, scaled("117", VOLT_SCALE), scaled("118", POWER_SCALE), none, none, scaled("119", ENERGY_SCALE)))
    rows = readings.withColumn("profile", profile).withColumn(
        "_c", F.explode(F.when(F.col("profile") == "pj1103a", shared).otherwise(blocks)))
    names = F.create_map(*[x for m, n, a in mapping for x in (F.lit(f"{m}/{n}"), F.lit(a))])
    key = F.concat_ws("/", "meter", F.col("_c.n").cast("string"))
    return rows.select(
        *keep, "meter", "profile", F.try_element_at(names, key).alias("channel"), "_c.voltage_v",
        "_c.power_w", "_c.current_a", "_c.energy_forward_kwh", "_c.energy_forward_kwh_inferred"
    ).filter(F.col("channel").isNotNull())


# ---- host agent ----------------------------------------------------------------------

HOST_AGENT = (
    "struct<cpu:struct<total:double,idle:double,cpucore:int>,percpu:array<struct<cpu_number:int,total:double,idle:double>>,"
    "load:struct<min1:double,min5:double,min15:double,cpucore:int>,"
    "mem:struct<percent:double,total:long,available:long,free:long>,"
    "memswap:struct<percent:double,used:long,total:long>,"
    "sensors:array<struct<type:string,label:string,value:double>>,"
    "fs:array<struct<mnt_point:string,mountpoint:string,device_name:string,device:string,percent:double,used:long,size:long,total:long,free:long>>,"
    "network:array<map<string,string>>,"
    "processlist:array<struct<name:string,username:string,cpu_percent:double,memory_percent:double,pid:long>>>"
)


def agent_payloads(payloads: DataFrame, payload: str = "payload", keep: Sequence[str] = ("host", "ts")) -> DataFrame:
    """Parsed host-agent payloads as one struct column ``agent``; the functions below take it."""
    return payloads.select(*keep, F.from_json(payload, HOST_AGENT).alias("agent"))


def _busy(total: Column, idle: Column) -> Column:
    return F.coalesce(total, F.greatest(F.lit(0.0), 100.0 - idle))


def agent_cores(parsed: DataFrame, keep: Sequence[str] = ("host", "ts")) -> DataFrame:
    rows = parsed.select(*keep, F.explode("agent.percpu").alias("_c"))
    out = rows.select(*keep, F.col("_c.cpu_number").alias("core"),
                      _busy(F.col("_c.total"), F.when(F.col("_c.idle").isNotNull(), F.col("_c.idle"))).alias("cpu_percent"))
    return out.filter(F.col("core").isNotNull() & F.col("cpu_percent").isNotNull())


def agent_sensors(parsed: DataFrame, keep: Sequence[str] = ("host", "ts")) -> DataFrame:
    """Core temperatures with their position, for ``hosts.cpu_temperature`` and the summary."""
    rows = parsed.select(*keep, F.posexplode("agent.sensors").alias("position", "_s"))
    return rows.filter((F.col("_s.type") == "temperature_core") & F.col("_s.value").isNotNull()).select(
        *keep, "position", "_s.type", F.coalesce(F.nullif("_s.label", F.lit("")), F.lit("sensor")).alias("label"),
        "_s.value")


def agent_filesystems(parsed: DataFrame, keep: Sequence[str] = ("host", "ts")) -> DataFrame:
    rows = parsed.select(*keep, F.explode("agent.fs").alias("_f"))
    mount = F.coalesce(F.nullif("_f.mnt_point", F.lit("")), F.nullif("_f.mountpoint", F.lit("")))
    device = F.coalesce(F.nullif("_f.device_name", F.lit("")), F.nullif("_f.device", F.lit("")))
    return rows.filter(mount.isNotNull() | device.isNotNull()).select(
        *keep, F.coalesce(device, F.lit("—")).alias("device"), F.coalesce(mount, F.lit("—")).alias("mount"),
        "_f.percent", F.col("_f.used").alias("used_bytes"),
        F.coalesce(F.nullif("_f.size", F.lit(0)), "_f.total").alias("total_bytes"),
        F.col("_f.free").alias("free_bytes"))


def agent_interfaces(parsed: DataFrame, keep: Sequence[str] = ("host", "ts")) -> DataFrame:
    return parsed.select(*keep, F.explode("agent.network").alias("entry"))


def agent_processes(parsed: DataFrame, keep: Sequence[str] = ("host", "ts")) -> DataFrame:
    return parsed.select(*keep, F.explode("agent.processlist").alias("_p")).select(*keep, "_p.*")


def agent_host_samples(parsed: DataFrame, keep: Sequence[str] = ("host", "ts")) -> DataFrame:
    """HOST_SAMPLE rows; a payload needs at least one load value. Interface rates are summed
    inside the row, over the handful of interfaces of one host."""
    from gaugeworks.operators.hosts import RECEIVE_FIELDS, SEND_FIELDS, network_rate

    load, mem, cpu = F.col("agent.load"), F.col("agent.mem"), F.col("agent.cpu")
    used = F.greatest(F.lit(0), mem["total"] - F.coalesce(mem["available"], mem["free"]))

    def rate(fields) -> Column:
        real = F.filter("agent.network", lambda e: ~F.coalesce(F.lower(F.coalesce(
            F.try_element_at(e, F.lit("interface_name")), F.try_element_at(e, F.lit("name")))).isin("lo", "loopback"), F.lit(False)))
        seen = F.filter(F.transform(real, lambda e: network_rate(e, fields)), lambda r: r.isNotNull())
        return F.when(F.size(seen) > 0, F.aggregate(seen, F.lit(0.0), lambda a, r: a + r))

    some = F.coalesce(load["min1"], load["min5"], load["min15"]).isNotNull()
    one = F.coalesce(load["min1"], F.lit(0.0))
    return parsed.filter(some).select(
        *keep, one.alias("load_1"), F.coalesce(F.nullif(load["min5"], F.lit(0.0)), one).alias("load_5"),
        F.coalesce(F.nullif(load["min15"], F.lit(0.0)), one).alias("load_15"),
        mem["percent"].alias("memory_used_percent"),
        F.when(F.coalesce(mem["available"], mem["free"]).isNotNull(), used).alias("memory_used_bytes"),
        mem["total"].alias("memory_total_bytes"), _busy(cpu["total"], cpu["idle"]).alias("cpu_percent"),
        F.coalesce(cpu["cpucore"], load["cpucore"]).alias("cpu_threads"),
        rate(RECEIVE_FIELDS).alias("network_rx_bps"), rate(SEND_FIELDS).alias("network_tx_bps"))
