"""The logical model: business objects over tables. Everything is plain data; nothing here touches Spark."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

#: Kinds of objects by English and Russian name (fixed values).
KINDS = dict(zip(
    "Справочник Документ ЖурналДокументов Перечисление РегистрСведений РегистрНакопления РегистрБухгалтерии ПланВидовХарактеристик ПланВидовРасчета ПланСчетов Константа ПланОбмена БизнесПроцесс Задача Последовательность КритерийОтбора".lower().split(),
    "Catalog Document DocumentJournal Enumeration InformationRegister AccumulationRegister AccountingRegister ChartOfCharacteristicTypes ChartOfCalculationTypes ChartOfAccounts Constant ExchangePlan BusinessProcess Task Sequence FilterCriterion".split(),
))
KINDS |= {v.lower(): v for v in list(KINDS.values())} | {"enum": "Enumeration", "reference": "Catalog"}

#: Standard fields: canonical name and further names (fixed values).
STANDARD = {
    "Ref": ("Ссылка", "ID"), "Code": ("Код",), "Description": ("Наименование",), "DeletionMark": ("ПометкаУдаления", "Marked"), "Number": ("Номер",), "Date": ("Дата",),
    "Posted": ("Проведен",), "Recorder": ("Регистратор",), "LineNumber": ("НомерСтроки", "LineNo"), "Period": ("Период",), "Active": ("Активность",), "RecordType": ("ВидДвижения", "RecordKind"),
    "Parent": ("Родитель", "ParentID"), "Owner": ("Владелец", "OwnerID"), "IsFolder": ("ЭтоГруппа",), "Predefined": ("Предопределенный",), "Order": ("Порядок", "EnumOrder"), "Value": ("Значение",),
    "Account": ("Счет",), "AccountDr": ("СчетДт", "AccountDt"), "AccountCr": ("СчетКт", "AccountCt"), "PointInTime": ("МоментВремени",), "PredefinedDataName": ("ИмяПредопределенныхДанных",),
}

#: Service tables: section and further names (fixed values).
SERVICE = {
    "Changes": ("Изменения",), "BaseCalculationKinds": ("BaseCalculationTypes", "БазовыеВидыРасчета"), "LeadingCalculationKinds": ("LeadingCalculationTypes", "ВедущиеВидыРасчета"),
    "DisplacedCalculationKinds": ("DisplacingCalculationTypes", "ВытесняющиеВидыРасчета"), "ExtraDimensions": ("ВидыСубконто",), "ExtDimensions": ("Субконто",),
}


@dataclass(frozen=True)
class Field:
    """sql: the value over the object's table. kind: string number boolean date ref composite point uuid binary unknown."""

    name: str
    sql: str
    kind: str
    aliases: tuple[str, ...] = ()
    targets: tuple[str, ...] = ()  # of a reference: full names of objects; several make it a (type, ref) struct
    purpose: str = "attribute"  # attribute dimension resource
    balance: bool = True  # of an accounting dimension or resource: shared by both sides
    side: str = ""  # dr or cr: of a non-balance accounting field and of account and extra-dimension columns

    @property
    def names(self) -> tuple[str, ...]:
        return (self.name, *self.aliases, *STANDARD.get(self.name, ()))


@dataclass
class Object:
    kind: str
    name: str
    fields: list[Field]
    table: str | Callable[[Callable], Any] = ""  # a table's name, or a function of the table reader
    aliases: tuple[str, ...] = ()
    type_no: int = 0
    register: str = "balance"  # of an accumulation register: balance or turnovers
    sections: dict[str, "Object"] = field(default_factory=dict)
    predefined: dict[str, Any] = field(default_factory=dict)
    presentation: tuple[str, ...] = ()  # field names, or 'text in quotes'
    separators: dict[str, str] = field(default_factory=dict)  # separator -> field
    extensions: tuple[str, ...] = ()  # tables with the same rows' shape, united with the base
    empty_ref: Any = None
    content: tuple[tuple[str, str], ...] = ()  # of a filter criterion: (object, field)
    ext_dimensions: int = 0  # of an accounting register: levels of ExtDimension<k>Dr and ...Cr, kinds in ExtDimensionType<k>

    @property
    def full_name(self) -> str:
        return f"{self.kind}.{self.name}"

    def section(self, name: str) -> "Object | None":
        """A tabular section or service table."""
        low = name.lower()
        return next((child for own, child in self.sections.items() if low in {n.lower() for n in (own, *child.aliases, *SERVICE.get(own, ()))}), None)

    def find(self, name: str) -> Field | None:
        low = name.lower()
        return next((f for f in self.fields if any(n.lower() == low for n in f.names)), None)

    def by_purpose(self, purpose: str) -> list[Field]:
        return [f for f in self.fields if f.purpose == purpose]


class Model:
    def __init__(self, objects: list[Object]):
        self.objects = objects
        self._by_name = {(o.kind, n.lower()): o for o in objects for n in (o.name, *o.aliases)}

    def kind(self, name: str) -> str | None:
        return KINDS.get(name.lower())

    def find(self, kind: str, name: str) -> Object | None:
        return self._by_name.get((self.kind(kind) or kind, name.lower()))

    def by_full_name(self, full: str) -> Object:
        kind, _, name = full.partition(".")
        found = self.find(kind, name)
        if found is None:
            raise KeyError(full)
        return found

    def constants(self) -> list[Object]:
        return [o for o in self.objects if o.kind == "Constant"]
