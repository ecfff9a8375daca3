"""A subset of FHIR R4, written down from the published definitions."""

from __future__ import annotations

#: Fixed values. A type, then its elements: name, cardinality (1: required, *: repeats, +: both, ?: neither) and types; ``[x]`` marks a choice element.
_RESOURCE = "id ? id; meta ? Meta; implicitRules ? uri; language ? code"
_DOMAIN = f"{_RESOURCE}; text ? Narrative; contained * Resource; extension * Extension; modifierExtension * Extension"
_ELEMENT = "id ? string; extension * Extension"
_BACKBONE = "{0}.id ? string; {0}.extension * Extension; {0}.modifierExtension * Extension"
_VALUES = "boolean integer decimal string uri code date dateTime time instant id markdown base64Binary positiveInt unsignedInt Quantity CodeableConcept Coding Reference Identifier HumanName Address ContactPoint Period Range Ratio Attachment"


def _backbone(name: str, body: str) -> str:
    return f"{name} * BackboneElement; {_BACKBONE.format(name)}; " + "; ".join(f"{name}.{part.strip()}" for part in body.split(";"))


_TYPES = {
    "Patient": ("resource", f"{_DOMAIN}; identifier * Identifier; active ? boolean; name * HumanName; telecom * ContactPoint; gender ? code; birthDate ? date; deceased[x] ? boolean dateTime; address * Address; maritalStatus ? CodeableConcept; multipleBirth[x] ? boolean integer; photo * Attachment; "
                + _backbone("contact", "relationship * CodeableConcept; name ? HumanName; telecom * ContactPoint; address ? Address; gender ? code; organization ? Reference; period ? Period") + "; "
                + _backbone("communication", "language 1 CodeableConcept; preferred ? boolean") + "; generalPractitioner * Reference; managingOrganization ? Reference; " + _backbone("link", "other 1 Reference; type 1 code")),
    "Observation": ("resource", f"{_DOMAIN}; identifier * Identifier; basedOn * Reference; partOf * Reference; status 1 code; category * CodeableConcept; code 1 CodeableConcept; subject ? Reference; focus * Reference; encounter ? Reference; effective[x] ? dateTime Period instant; issued ? instant; performer * Reference; "
                    "value[x] ? Quantity CodeableConcept string boolean integer Range Ratio time dateTime Period; dataAbsentReason ? CodeableConcept; interpretation * CodeableConcept; note * Annotation; bodySite ? CodeableConcept; method ? CodeableConcept; specimen ? Reference; device ? Reference; hasMember * Reference; derivedFrom * Reference; "
                    + _backbone("referenceRange", "low ? Quantity; high ? Quantity; type ? CodeableConcept; appliesTo * CodeableConcept; age ? Range; text ? string") + "; "
                    + _backbone("component", "code 1 CodeableConcept; value[x] ? Quantity CodeableConcept string boolean integer Range Ratio time dateTime Period; dataAbsentReason ? CodeableConcept; interpretation * CodeableConcept; referenceRange * #Observation.referenceRange")),
    "Organization": ("resource", f"{_DOMAIN}; identifier * Identifier; active ? boolean; type * CodeableConcept; name ? string; alias * string; telecom * ContactPoint; address * Address; partOf ? Reference; endpoint * Reference; " + _backbone("contact", "purpose ? CodeableConcept; name ? HumanName; telecom * ContactPoint; address ? Address")),
    "Practitioner": ("resource", f"{_DOMAIN}; identifier * Identifier; active ? boolean; name * HumanName; telecom * ContactPoint; address * Address; gender ? code; birthDate ? date; photo * Attachment; communication * CodeableConcept"),
    "Medication": ("resource", f"{_DOMAIN}; identifier * Identifier; code ? CodeableConcept; status ? code; manufacturer ? Reference; form ? CodeableConcept; amount ? Ratio"),
    "MedicationRequest": ("resource", f"{_DOMAIN}; identifier * Identifier; status 1 code; intent 1 code; medication[x] 1 CodeableConcept Reference; subject 1 Reference; encounter ? Reference; authoredOn ? dateTime; requester ? Reference; note * Annotation"),
    "Communication": ("resource", f"{_DOMAIN}; identifier * Identifier; status 1 code; subject ? Reference; sent ? dateTime; received ? dateTime; recipient * Reference; sender ? Reference; " + _backbone("payload", "content[x] 1 string Attachment Reference") + "; note * Annotation"),
    "ExplanationOfBenefit": ("resource", f"{_DOMAIN}; identifier * Identifier; status 1 code; type 1 CodeableConcept; use 1 code; patient 1 Reference; created 1 dateTime; insurer 1 Reference; provider 1 Reference; outcome 1 code; " + _backbone("insurance", "focal 1 boolean; coverage 1 Reference") + "; " + _backbone("item", "sequence 1 positiveInt; productOrService 1 CodeableConcept; serviced[x] ? date Period; quantity ? Quantity; unitPrice ? Money; net ? Money")),
    "Questionnaire": ("resource", f"{_DOMAIN}; url ? uri; identifier * Identifier; version ? string; name ? string; title ? string; status 1 code; experimental ? boolean; subjectType * code; date ? dateTime; publisher ? string; description ? markdown; code * Coding; " + _backbone("item", "linkId 1 string; definition ? uri; code * Coding; prefix ? string; text ? string; type 1 code; required ? boolean; repeats ? boolean; readOnly ? boolean; maxLength ? integer; answerValueSet ? uri; item * #Questionnaire.item")),
    "Bundle": ("resource", f"{_RESOURCE}; identifier ? Identifier; type 1 code; timestamp ? instant; total ? unsignedInt; " + _backbone("link", "relation 1 string; url 1 uri") + "; " + _backbone("entry", "link * #Bundle.link; fullUrl ? uri; resource ? Resource")
               + "; entry.search ? BackboneElement; entry.search.mode ? code; entry.search.score ? decimal; entry.request ? BackboneElement; entry.request.method 1 code; entry.request.url 1 uri; entry.response ? BackboneElement; entry.response.status 1 string; entry.response.location ? uri"),
    "HumanName": ("complex-type", f"{_ELEMENT}; use ? code; text ? string; family ? string; given * string; prefix * string; suffix * string; period ? Period"),
    "Identifier": ("complex-type", f"{_ELEMENT}; use ? code; type ? CodeableConcept; system ? uri; value ? string; period ? Period; assigner ? Reference"),
    "CodeableConcept": ("complex-type", f"{_ELEMENT}; coding * Coding; text ? string"),
    "Coding": ("complex-type", f"{_ELEMENT}; system ? uri; version ? string; code ? code; display ? string; userSelected ? boolean"),
    "Quantity": ("complex-type", f"{_ELEMENT}; value ? decimal; comparator ? code; unit ? string; system ? uri; code ? code"),
    "Money": ("complex-type", f"{_ELEMENT}; value ? decimal; currency ? code"),
    "Reference": ("complex-type", f"{_ELEMENT}; reference ? string; type ? uri; identifier ? Identifier; display ? string"),
    "Extension": ("complex-type", f"{_ELEMENT}; url 1 uri; value[x] ? {_VALUES}"),
    "Meta": ("complex-type", f"{_ELEMENT}; versionId ? id; lastUpdated ? instant; source ? uri; profile * canonical; security * Coding; tag * Coding"),
    "Attachment": ("complex-type", f"{_ELEMENT}; contentType ? code; language ? code; data ? base64Binary; url ? url; size ? unsignedInt; hash ? base64Binary; title ? string; creation ? dateTime"),
    "Narrative": ("complex-type", f"{_ELEMENT}; status 1 code; div 1 xhtml"),
    "Period": ("complex-type", f"{_ELEMENT}; start ? dateTime; end ? dateTime"),
    "Range": ("complex-type", f"{_ELEMENT}; low ? Quantity; high ? Quantity"),
    "Ratio": ("complex-type", f"{_ELEMENT}; numerator ? Quantity; denominator ? Quantity"),
    "Annotation": ("complex-type", f"{_ELEMENT}; author[x] ? Reference string; time ? dateTime; text 1 markdown"),
    "Address": ("complex-type", f"{_ELEMENT}; use ? code; type ? code; text ? string; line * string; city ? string; district ? string; state ? string; postalCode ? string; country ? string; period ? Period"),
    "ContactPoint": ("complex-type", f"{_ELEMENT}; system ? code; value ? string; use ? code; rank ? positiveInt; period ? Period"),
}

#: The formats that R4 declares for its primitive types; those with null have none.
_PRIMITIVES = {
    "boolean": None, "integer": None, "decimal": None, "positiveInt": None, "unsignedInt": None, "xhtml": None,
    "string": r"[ \r\n\t\S]+", "markdown": r"\s*(\S|\s)*", "code": r"[^\s]+(\s[^\s]+)*", "id": r"[A-Za-z0-9\-\.]{1,64}", "uri": r"\S*", "url": r"\S*", "canonical": r"\S*", "oid": r"urn:oid:[0-2](\.(0|[1-9][0-9]*))+",
    "uuid": r"urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "base64Binary": r"(\s*([0-9a-zA-Z\+/=]){4}\s*)+",
    "date": r"([0-9]([0-9]([0-9][1-9]|[1-9]0)|[1-9]00)|[1-9]000)(-(0[1-9]|1[0-2])(-(0[1-9]|[1-2][0-9]|3[0-1]))?)?",
    "dateTime": r"([0-9]([0-9]([0-9][1-9]|[1-9]0)|[1-9]00)|[1-9]000)(-(0[1-9]|1[0-2])(-(0[1-9]|[1-2][0-9]|3[0-1])(T([01][0-9]|2[0-3]):[0-5][0-9]:([0-5][0-9]|60)(\.[0-9]+)?(Z|(\+|-)((0[0-9]|1[0-3]):[0-5][0-9]|14:00)))?)?)?",
    "instant": r"([0-9]([0-9]([0-9][1-9]|[1-9]0)|[1-9]00)|[1-9]000)-(0[1-9]|1[0-2])-(0[1-9]|[1-2][0-9]|3[0-1])T([01][0-9]|2[0-3]):[0-5][0-9]:([0-5][0-9]|60)(\.[0-9]+)?(Z|(\+|-)((0[0-9]|1[0-3]):[0-5][0-9]|14:00))",
    "time": r"([01][0-9]|2[0-3]):[0-5][0-9]:([0-5][0-9]|60)(\.[0-9]+)?",
}

#: Type, path, key, severity, text, expression.
_CONSTRAINTS = [
    ("Bundle", "", "bdl-1", "error", "total only when a search or history", "total.empty() or (type = 'searchset') or (type = 'history')"),
    ("Bundle", "", "bdl-2", "error", "entry.search only when a search", "entry.search.empty() or (type = 'searchset')"),
    ("Bundle", "entry", "bdl-5", "error", "must be a resource unless there's a request or response", "resource.exists() or request.exists() or response.exists()"),
    ("Patient", "contact", "pat-1", "error", "SHALL at least contain a contact's details or a reference to an organization", "name.exists() or telecom.exists() or address.exists() or organization.exists()"),
    ("Observation", "", "obs-6", "error", "dataAbsentReason SHALL only be present if Observation.value[x] is not present", "dataAbsentReason.empty() or value.empty()"),
    ("Observation", "referenceRange", "obs-3", "error", "Must have at least a low or a high or text", "low.exists() or high.exists() or text.exists()"),
    ("Organization", "", "org-1", "error", "The organization SHALL at least have a name or an identifier, and possibly more than one", "(identifier.count() + name.count()) > 0"),
    ("Quantity", "", "qty-3", "error", "If a code for the unit is present, the system SHALL also be present", "code.empty() or system.exists()"),
    ("Period", "", "per-1", "error", "If present, start SHALL have a lower value than end", "start.hasValue().not() or end.hasValue().not() or (start <= end)"),
    ("Attachment", "", "att-1", "error", "If the Attachment has data, it SHALL have a contentType", "data.empty() or contentType.exists()"),
    ("ContactPoint", "", "cpt-2", "error", "A system is required if a value is provided.", "value.empty() or system.exists()"),
    ("Questionnaire", "", "que-0", "warning", "Name should be usable as an identifier for the module by machine processing applications such as code generation", "name.matches('[A-Z]([A-Za-z0-9_]){0,254}')"),
] + [
    (t, "", "dom-6", "warning", "A resource should have narrative for robust management", "text.`div`.exists()")
    for t in ("Patient", "Observation", "Organization", "Practitioner", "Medication", "MedicationRequest", "Communication", "ExplanationOfBenefit", "Questionnaire")
] + [
    (t, "", "dom-3", "error", "If the resource is contained in another resource, it SHALL be referred to from elsewhere in the resource", "contained.where((('#'+id in (%resource.descendants().reference))).not()).empty()")
    for t in ("Patient", "Observation")
]


def tables() -> tuple[list, list, list, list]:
    """Rows of the types, elements, constraints and patterns tables."""
    types = [(name, kind) for name, (kind, _) in _TYPES.items()] + [(name, "primitive-type") for name in _PRIMITIVES]
    elements = []
    for type_, (_, body) in _TYPES.items():
        for part in body.split(";"):
            path, cardinality, *kinds = part.split()
            elements.append((type_, path.removesuffix("[x]"), int(cardinality in "1+"), cardinality in "*+", path.endswith("[x]"), kinds))
    patterns = [(name, p) for name, p in _PRIMITIVES.items() if p]
    return types, elements, list(_CONSTRAINTS), patterns
