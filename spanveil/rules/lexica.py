"""Lexicon packs: labels of form fields, honorifics, contexts of names, sensitive terms and negative terms by region."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Pack:
    """Terms as lines ``kind[ category]: term, term``; kinds are label, honorific, context, sensitive and negative."""

    id: str
    jurisdictions: tuple[str, ...]
    lines: str

    def terms(self) -> list[tuple[str, str, str]]:
        """(kind, category, term) of every term."""
        out = []
        for line in self.lines.strip().splitlines():
            head, values = line.split(":", 1)
            kind, _, category = head.strip().partition(" ")
            out += [(kind, category, v.strip()) for v in values.split(",")]
        return out


# Fixed values.
APAC_EN = Pack("apac_en", ("sg", "au", "nz", "in"), """
label name: name, full name, legal name, contact person
label email: email, e-mail
label phone: phone, mobile, contact number
label address: address, postal code, postcode, residential address
label date_of_birth: date of birth, dob
label health: medical, diagnosis, patient, treatment
label tax_id: national id, tax file number, fin, nric, aadhaar
honorific: mr, mrs, ms, dr, prof
context: my name is, signed by, contact person
sensitive health: diagnosis, patient, prescription, medical certificate, medical leave
sensitive religion: religion, faith, church, mosque, synagogue, temple
sensitive politics: political party, campaign, political affiliation
sensitive union: trade union, union member, industrial action
sensitive biometric: fingerprint, facial recognition, iris, voiceprint
sensitive criminal: criminal record, conviction, court order, probation
negative: horse, tiger, project, release
""")
DE_DACH = Pack("de_dach", ("de", "at", "ch"), """
label name: name, voller name, vorname, nachname, ansprechpartner
label email: e-mail, email, mail
label phone: telefon, telefonnummer, handy, mobil, tel
label address: adresse, anschrift, wohnort, straße, strasse
label date_of_birth: geburtsdatum, geb., geboren am
label health: diagnose, krankheit, therapie, behandlung, patient
label tax_id: steuer-id, steuer id, steueridentifikationsnummer, steuernummer
label insurance: versichertennummer, sozialversicherungsnummer, svnr
honorific: herr, frau, dr, prof, prof dr
context: mein name ist, ich heiße, unterzeichnet von, ansprechpartner ist
sensitive health: diagnose, medikation, krankenhaus, arbeitsunfähig, au-bescheinigung
sensitive religion: religion, konfession, kirche, moschee, synagoge
sensitive politics: partei, wahlkampf, fraktion, mitgliedschaft
sensitive union: gewerkschaft, betriebsrat, tarifvertrag
sensitive biometric: fingerabdruck, gesichtserkennung, iris, stimmerkennung
sensitive criminal: vorstrafe, ermittlungsverfahren, haftbefehl, strafregister
negative: pferd, tiger, projekt, version, vertrag
""")
EN_UK_IE = Pack("en_uk_ie", ("uk", "ie"), """
label name: name, full name, surname, family name, contact person
label email: email, e-mail, mail
label phone: phone, telephone, mobile, contact number, tel
label address: address, postal address, home address, postcode
label date_of_birth: date of birth, dob, born on
label health: diagnosis, medical, patient, treatment, nhs
label tax_id: national insurance, national insurance number, nino
honorific: mr, mrs, ms, miss, dr, prof, sir, dame
context: my name is, signed by, contact person, for the attention of
sensitive health: diagnosis, prescription, mental health, medical leave, patient record
sensitive religion: religion, faith, church, mosque, synagogue, temple
sensitive politics: political opinion, party membership, campaign donor, manifesto
sensitive union: trade union, union member, collective bargaining
sensitive biometric: fingerprint, facial recognition, iris scan, voiceprint
sensitive criminal: criminal record, conviction, custody, probation
negative: horse, tiger, project, release, roadmap
""")
EN_US_CA = Pack("en_us_ca", ("us", "ca"), """
label name: name, full name, legal name, contact
label email: email, e-mail
label phone: phone, cell, mobile, contact number
label address: address, street address, zip code, postal code, state, province
label date_of_birth: date of birth, dob, birthday
label health: medical, diagnosis, patient, treatment, hipaa
label tax_id: ssn, social security number, sin, social insurance number, tax id, tin
honorific: mr, mrs, ms, mx, dr, prof
context: my name is, signed by, employee name, customer name
sensitive health: diagnosis, patient, prescription, medical leave, disability
sensitive religion: religion, faith, church, mosque, synagogue, temple
sensitive politics: voter, campaign, political affiliation, party registration
sensitive union: union member, labor union, collective bargaining, shop steward
sensitive biometric: fingerprint, face scan, retina, voice biometrics
sensitive criminal: criminal record, felony, misdemeanor, parole, probation
negative: horse, cougar, project, roadmap, sprint
""")
ES_ES_LATAM = Pack("es_es_latam", ("es", "mx", "ar", "co", "cl", "pe"), """
label name: nombre, nombre completo, apellido, apellidos, persona de contacto
label email: correo, correo electronico, correo electrónico, email
label phone: telefono, teléfono, movil, móvil, celular
label address: direccion, dirección, domicilio, codigo postal, código postal
label date_of_birth: fecha de nacimiento, nacido el, nacida el
label health: diagnostico, diagnóstico, tratamiento, paciente, salud
label tax_id: dni, nif, nie, identificacion, identificación
honorific: sr, sra, srta, dr, dra
context: me llamo, mi nombre es, firmado por, persona de contacto
sensitive health: diagnóstico, medicación, historial clínico, baja médica, paciente
sensitive religion: religion, religión, iglesia, mezquita, sinagoga
sensitive politics: afiliación política, partido, campaña, militancia
sensitive union: sindicato, afiliado sindical, convenio colectivo
sensitive biometric: huella, reconocimiento facial, iris, voz
sensitive criminal: antecedentes penales, condena, investigación penal
negative: caballo, proyecto, version, contrato
""")
FR_FR_BE = Pack("fr_fr_be", ("fr", "be"), """
label name: nom, nom complet, prenom, prénom, nom de famille
label email: e-mail, email, courriel
label phone: telephone, téléphone, portable, mobile
label address: adresse, code postal, domicile, rue
label date_of_birth: date de naissance, ne le, née le
label health: diagnostic, traitement, patient, medical, médical
label tax_id: nir, numero de securite sociale, numéro de sécurité sociale
honorific: m, mme, mlle, dr, pr
context: je m'appelle, signe par, contact principal
sensitive health: diagnostic, ordonnance, hospitalisation, patient, arrêt maladie
sensitive religion: religion, foi, eglise, église, mosquée, synagogue
sensitive politics: opinion politique, parti, campagne, militant
sensitive union: syndicat, représentant syndical, convention collective
sensitive biometric: empreinte, reconnaissance faciale, iris, voix
sensitive criminal: casier judiciaire, condamnation, mise en examen
negative: cheval, projet, version, contrat
""")
PT_BR = Pack("pt_br", ("br",), """
label name: nome, nome completo, sobrenome, contato
label email: email, e-mail, correio eletrônico
label phone: telefone, celular, contato
label address: endereco, endereço, cep, logradouro, domicilio
label date_of_birth: data de nascimento, nascido em, nascida em
label health: diagnostico, diagnóstico, tratamento, paciente, saude, saúde
label tax_id: cpf, cadastro de pessoas fisicas, cadastro de pessoas físicas, rg
honorific: sr, sra, dr, dra, prof
context: me chamo, meu nome é, assinado por, responsável
sensitive health: diagnóstico, medicação, prontuário, afastamento médico, paciente
sensitive religion: religião, igreja, mesquita, sinagoga, templo
sensitive politics: opinião política, partido, campanha, filiação partidária
sensitive union: sindicato, dirigente sindical, convenção coletiva
sensitive biometric: impressão digital, reconhecimento facial, íris, voz
sensitive criminal: antecedentes criminais, condenação, investigação criminal
negative: cavalo, projeto, versao, versão
""")
PACKS = (APAC_EN, DE_DACH, EN_UK_IE, EN_US_CA, ES_ES_LATAM, FR_FR_BE, PT_BR)
# ---- end of fixed values ----
