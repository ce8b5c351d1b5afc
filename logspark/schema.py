"""The two record schemas and the fixed lookup values of the log formats."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, str]) -> T.StructType:
    kinds = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "timestamp": T.TimestampType(), "map": T.MapType(T.StringType(), T.StringType())}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in fields])


EVENTLOG_SCHEMA = _struct(
    ("id", "string"), ("DateTime", "timestamp"), ("DateFormatted", "string"), ("Event", "string"), ("User", "string"), ("UserUuid", "string"),
    ("Metadata", "string"), ("MetadataUuid", "string"), ("Tran", "string"), ("TransactionDate", "timestamp"), ("TransactionNumber", "long"),
    ("Application", "string"), ("Comment", "string"), ("Severity", "string"), ("Data", "string"), ("DataPresentation", "string"),
    ("Computer", "string"), ("Server", "string"), ("Connection", "string"), ("MainPort", "string"), ("AddPort", "string"), ("Session", "string"),
    ("TransactionStatus", "string"), ("AppTypeName", "string"), ("FileName", "string"), ("FileSize", "long"), ("FileSizeFormatted", "string"), ("RepeatCount", "int"),
)

TECHLOG_SCHEMA = _struct(
    ("id", "string"), ("DateTime", "timestamp"), ("DateFormatted", "string"), ("Duration", "long"), ("DurationMs", "double"), ("DurationSec", "double"),
    ("DurationFormatted", "string"), ("Event", "string"), ("Level", "int"), ("ProcessName", "string"), ("ProcessId", "string"), ("Spid", "string"),
    ("OSThread", "string"), ("SessionId", "string"), ("LongInfoName", "string"), ("LongInfoWait", "long"), ("User", "string"), ("Application", "string"),
    ("ConnectId", "string"), ("ClientId", "string"), ("Context", "string"), ("Sql", "string"), ("Locks", "string"), ("WaitConnections", "string"),
    ("LkSrc", "string"), ("Descr", "string"), ("Rows", "long"), ("InBytes", "long"), ("OutBytes", "long"), ("Method", "string"), ("Url", "string"), ("Properties", "map"),
)

# Fixed values of the log formats: names and texts as the platform writes and shows them.
SYSTEM_EVENTS = {
    "_$Session$_.Start": "Сеанс. Начало",
    "_$Session$_.Finish": "Сеанс. Завершение",
    "_$Session$_.Authentication": "Сеанс. Аутентификация",
    "_$Session$_.AuthenticationError": "Сеанс. Ошибка аутентификации",
    "_$Access$_.Access": "Доступ. Доступ",
    "_$Access$_.AccessDenied": "Доступ. Отказ в доступе",
    "_$OpenID$_.Authentication": "OpenID. Аутентификация",
    "_$OpenID$_.AuthenticationError": "OpenID. Ошибка аутентификации",
    "_$InfoBase$_.ConfigUpdate": "Информационная база. Изменение конфигурации",
    "_$InfoBase$_.DBConfigUpdate": "Информационная база. Изменение конфигурации базы данных",
    "_$InfoBase$_.EventLogSettingsUpdate": "Информационная база. Изменение параметров журнала регистрации",
    "_$InfoBase$_.InfoBaseAdmParamsUpdate": "Информационная база. Изменение параметров информационной базы",
    "_$InfoBase$_.MasterNodeUpdate": "Информационная база. Изменение главного узла",
    "_$InfoBase$_.RegionalSettingsUpdate": "Информационная база. Изменение региональных установок",
    "_$InfoBase$_.TARInfo": "Тестирование и исправление. Сообщение",
    "_$InfoBase$_.TARMess": "Тестирование и исправление. Предупреждение",
    "_$InfoBase$_.TARImportant": "Тестирование и исправление. Ошибка",
    "_$Data$_.New": "Данные. Добавление",
    "_$Data$_.Update": "Данные. Изменение",
    "_$Data$_.Delete": "Данные. Удаление",
    "_$Data$_.TotalsPeriodUpdate": "Данные. Изменение периода рассчитанных итогов",
    "_$Data$_.Post": "Данные. Проведение",
    "_$Data$_.Unpost": "Данные. Отмена проведения",
    "_$User$_.New": "Пользователи. Добавление",
    "_$User$_.Update": "Пользователи. Изменение",
    "_$User$_.Delete": "Пользователи. Удаление",
    "_$User$_.AuthenticationLock": "Пользователи. Блокировка аутентификации",
    "_$User$_.AuthenticationUnlock": "Пользователи. Разблокировка аутентификации",
    "_$Job$_.Start": "Фоновое задание. Запуск",
    "_$Job$_.Succeed": "Фоновое задание. Успешное завершение",
    "_$Job$_.Fail": "Фоновое задание. Ошибка выполнения",
    "_$Job$_.Cancel": "Фоновое задание. Отмена",
    "_$PerformError$_": "Ошибка выполнения",
    "_$Transaction$_.Begin": "Транзакция. Начало",
    "_$Transaction$_.Commit": "Транзакция. Фиксация",
    "_$Transaction$_.Rollback": "Транзакция. Отмена",
}
APP_TYPES = {
    "1CV8C": "Тонкий клиент",
    "1CV8": "Толстый клиент",
    "BackgroundJob": "Фоновое задание",
    "WebClient": "Веб-клиент",
    "COMConnector": "COM-соединение",
    "WSConnection": "Web-сервис",
    "HTTPServiceConnection": "HTTP-сервис",
    "Designer": "Конфигуратор",
    "RAS": "Сервер администрирования (RAS)",
    "RAC": "Консоль администрирования (RAC)",
    "WebServerExtension": "Расширение веб-сервера",
    "OData": "Интерфейс OData",
    "MobileClient": "Мобильный клиент",
    "MobileServer": "Мобильный сервер",
    "System": "Системный процесс",
}
SEVERITIES = {"I": "Информация", "E": "Ошибка", "W": "Предупреждение", "N": "Примечание"}
LGD_SEVERITIES = {0: "Информация", 1: "Предупреждение", 2: "Ошибка", 3: "Примечание"}
TRANSACTION_STATUS = {"C": "Зафиксирована", "R": "Отменена", "U": "Не завершена", "N": "Нет транзакции"}
TECHLOG_EVENTS = [
    "DBMSSQL", "DBPOSTGRS", "DBORACLE", "DBV8DBENG", "EXCP", "EXCPCNTX", "QERR", "CALL", "SCALL", "SDBL", "TLOCK", "TTIMEOUT",
    "TDEADLOCK", "SESN", "CONN", "ADMIN", "VRSREQUEST", "VRSRESPONSE", "HASP", "MEM", "LEAKS", "ATTN", "LONGDURATIONINFO",
]
TECHLOG_FACET_EVENTS = [*TECHLOG_EVENTS, "DBIBMDB2", "RUNMETH", "ADDIN", "Context", "PROC", "LIC", "PERF", "SCOM", "SDISPATCH", "CLSTR", "RESTP"]
DICTIONARY_KINDS = {1: "user", 2: "computer", 3: "app", 4: "event", 5: "metadata", 6: "server", 7: "port", 8: "addport"}
NO_NAME = "<Не указан>"
